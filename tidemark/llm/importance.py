"""Quality classifier (op3): importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled as good) and one of the raw corpus, give
every document a log importance weight: `strength` times the mean of log p_target - log p_raw over its n-grams, where PRIOR
n-grams of ratio 1 are mixed in, so that a short text weighs little. The sum over a long text would be thousands,
beside which a Gumbel variate is nothing and top-k would sample nothing; the strength is the number of n-grams that a document counts
for. Adding a Gumbel variate to each log weight and taking the k largest samples k documents without replacement by weight.

The raw model counts every document. The target model is fitted on at most max_docs labelled documents, chosen by a hash.
N-grams are single tokens and pairs: runs of letters or digits, runs of
punctuation, line breaks; a token that repeats the last or the one before is marked, so loops are n-grams of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Poly, arrow_batches, discard, hashed_sample, mix, pieces, read_table, stage, texts

BUCKETS = 1 << 16
#: n-grams of equal probability in both models that every text has besides its own
PRIOR = 20
_POLY = Poly(61)
# classes of bytes: 0 blank, 1 word, 2 punctuation, 3 line break
_KIND = np.array([3 if b == 10 else 0 if b <= 32 else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.int8)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of a piece, and its document."""
    n, docs = len(buf), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[buf]
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    k = kind[starts].astype(np.uint64)
    prefix = _POLY.of_bytes(buf)
    whole = _POLY.spans(prefix, starts, ends)
    code = whole + k
    d = np.searchsorted(offsets, starts, "right") - 1
    again = np.zeros(len(code), np.uint64)
    for back in (1, 2):
        again[back:] |= ((whole[back:] == whole[:-back]) & (d[back:] == d[:-back])).astype(np.uint64)
    code = mix(code * np.uint64(2) + again)
    pair = d[1:] == d[:-1]
    two = mix(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:])[pair]
    top = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([code >> top, two >> top]).astype(np.int64), np.concatenate([d, d[1:][pair]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket counts of a whole partition."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        buf, offsets = texts(batch.column(0))
        for i, j in pieces(offsets):
            total += np.bincount(features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def count(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """N-gram counts of all rows, by bucket; the driver gets one row for each bucket."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def threshold(keys: DataFrame, k: int, few: int = 10_000) -> float:
    """The k-th largest value of the column key: histograms of 4096 bins, each within the last one's bin that holds it."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n == 0 or k <= 0:
        return float("inf")
    k = min(k, n)
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return low
        bins = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b][0]:
                break
            k -= bins[b][0]
        size, low, high = bins[b]
        if low == high:
            return low
        if size <= few:
            found = sorted((r.key for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)
            return found[k - 1]


def gumbel(item: "F.Column", seed: "F.Column") -> "F.Column":
    """A standard Gumbel variate that hangs on an item and a seed."""
    uniform = (F.pmod(F.xxhash64(item, seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def importance_sample(docs: DataFrame, good: DataFrame, keep: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 3, smoothing: float = 1.0, strength: float = 30.0) -> DataFrame:
    """doc_id, log_weight, kept of each input row; kept marks the Gumbel top-k, k = keep times the rows, rounded.

    good holds texts of the target (column text). Null or empty text has no n-grams and log weight 0. The Gumbel variate hangs
    on the id, so reruns agree and repeated rows share their fate; rows that tie with the k-th are kept too. A
    null id is an id. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw, target = count(rows) + smoothing, count(good) + smoothing
    odds = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts(batch.column(1))
            out = []
            for i, j in pieces(offsets):
                bucket, d = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out.append(strength * np.bincount(d, odds[bucket], j - i).astype(np.float64) / (np.bincount(d, minlength=j - i) + PRIOR))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "log_weight"])

    keyed = stage(rows.mapInArrow(run, "doc_id long, log_weight double").withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), F.lit(seed))), "op3-keys")
    limit = threshold(keyed, round(keep * keyed.count()))
    return keyed.select("doc_id", "log_weight", (F.col("key") >= limit).alias("kept"))


def op3_importance(spark: SparkSession, sf_dir: str, max_docs: int = 20_000) -> DataFrame:
    """k is the share of good documents among the labelled ones, of all rows."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    share = labels.agg(F.avg("quality")).first()[0]
    ids = hashed_sample(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", max_docs).collect()
    picked = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in ids], "doc_id long"))
    good = stage(docs.join(picked, "doc_id", "left_semi").select("text"), "op3-target")
    out = importance_sample(docs, good, 1.0 if share is None else share)
    discard(good)
    return out
