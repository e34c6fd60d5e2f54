"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, minhash_dedup, mixing, pieces, toxicity
from tidemark.llm.common import discard, read_table, stage, unused


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, in the order of their ids, null ids last and equal ids by their texts; and its name.

    That is doc_id itself if ids are unique. Else the rows are numbered in a staged table.
    """
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1)
    if not repeats.collect():
        return docs, "doc_id"
    key, order = unused(docs.columns, "row"), [F.asc_nulls_last("doc_id"), F.asc_nulls_last("text")]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id())
    return stage(rows, "pipeline-rows"), key


def _kept(docs: DataFrame, dedup) -> DataFrame:
    """The rows of docs that an operator keeps, all columns unchanged; rows are chosen one by one, not by their ids."""
    rows, key = _keyed(docs)
    kept = dedup(rows.select(F.col(key).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 stay; the model is fitted on labelled documents of this stage's input.

    Null and empty texts are scored as empty. Rows with a null id are scored too, but never train; repeated rows stay or go together. An empty table stays empty.
    """
    return toxicity.clean(docs, toxicity.train(spark, docs, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space aside; null is empty) one stays: that with the smallest id, of equal ids any one, one without an id only if none has one."""
    return _kept(docs, exact_dedup.exact_dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. Linked: five-word shingles of similarity 0.8; 34 bands miss such a pair with probability 2e-8.

    Texts without words, null or not, are linked with nothing and all stay. Ids as in drop_exact_copies. An empty table stays empty.
    """
    return _kept(docs, lambda rows: minhash_dedup.minhash_dedup(rows, width=5, percent=80, bands=34))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all where its source's target is below its size. Texts without words stay once."""
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of each row of the mix; null text is empty and has no ids."""
    return pieces.encode(docs, pieces.Pieces.read(pieces.DEFAULT_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("pieces", to_pieces),
]

#: SQL cannot express the fitted and seeded stages; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
