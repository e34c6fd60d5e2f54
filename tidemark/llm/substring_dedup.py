"""Substring dedup (op1): a log-structured fingerprint index for incremental deduplication.

The index is a list of immutable runs. A run holds the fingerprints of the windows of one batch of documents (phrase rows
of repeats.py: the trigger's hash, the phrase's hash, where it first occurs), in buckets by trigger, sorted. A new batch is
fingerprinted and merge-joined with every run on the trigger's hash: the runs are read where they lie, only
the batch and the rows that match are shuffled. What meets is verified: phrases of one
trigger are equal if two independent 64-bit hashes agree; where they differ, their windows are brought from the texts
of both sides and compared word by word. Fingerprints that no run has are written as the next run; when
there are more than max_runs before a batch, all are merged bucket by bucket into one that keeps the first occurrence of each.

The index lives in a folder: its runs and a list of them, by which it can be opened again.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read_table, read_text, scratch, stage, word_spans, write_text
from .repeats import WORDS, covered, finish, identified, phrase_table, repeated

_RUN = ["doc", "start", "n", "g", "c"]


def _kernel(texts_too: bool):
    def run(ids, buf, offsets, d, start, n) -> pa.RecordBatch:
        starts, ends, first = word_spans(buf, offsets)
        gone = covered(len(starts), first, d, start, n, WORDS.win)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        s, size = starts[~gone], ends[~gone] - starts[~gone] + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.append(buf, np.uint8(32))[np.repeat(s - at[:-1], size) + np.arange(at[-1])] if len(s) else buf[:0].copy()
        out[at[1:] - 1] = 32  # one space after each word
        word = np.concatenate([[0], np.cumsum(np.diff(first) - removed)])
        text = out.tobytes()
        rest = [text[a : b - 1] if b > a else b"" for a, b in zip(at[word[:-1]].tolist(), at[word[1:]].tolist())]
        cols = [ids, pa.array(np.diff(first)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in rest])]
        return pa.RecordBatch.from_arrays(cols + [pa.array(rest, pa.binary()).cast(pa.string())] * texts_too, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts_too)

    return run


class FingerprintIndex:
    """Runs of fingerprints in a folder, and the texts they point to (doc, text; kept by the caller, read only to verify).

    A folder that holds an index is opened; history then has the texts of the documents in it. Documents must be numbered
    in their order, later batches higher, by unique longs.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, history: DataFrame | None = None, max_runs: int = 4, buckets: int | None = None):
        self.spark, self.folder, self.max_runs, self.history = spark, folder or scratch(spark, "op1-index"), max_runs, history
        listed = json.loads(read_text(spark, f"{self.folder}/runs.json") or "{}")
        self.buckets = listed.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths = listed.get("runs", [])
        self.runs = [self._table(p) for p in self.paths]

    def _table(self, path: str) -> DataFrame:
        """A run as a table that Spark knows the buckets of; the name is this session's, the files are the run."""
        name = f"tidemark_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (doc BIGINT, start INT, n INT, g BIGINT, c BIGINT) USING parquet OPTIONS (path '{path}') CLUSTERED BY (g) SORTED BY (g, c) INTO {self.buckets} BUCKETS")
        out = self.spark.table(name)
        out.table_name, out.scratch_path = name, path
        return out

    def _write(self, dealt: DataFrame) -> str:
        """Write rows that lie in as many partitions as there are buckets, by trigger, as a run."""
        path, name = f"{self.folder}/run-{uuid.uuid4().hex}", f"tidemark_new_{uuid.uuid4().hex}"
        dealt.select(*_RUN).write.bucketBy(self.buckets, "g").sortBy("g", "c").format("parquet").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return path

    def _list(self, paths: list[str]) -> None:
        """Make these the index's runs, from now on and when it is opened again."""
        write_text(self.spark, f"{self.folder}/runs.json", json.dumps({"buckets": self.buckets, "runs": paths}))
        gone = [r for p, r in zip(self.paths, self.runs) if p not in paths]
        known = dict(zip(self.paths, self.runs))
        self.paths, self.runs = paths, [known.get(p) or self._table(p) for p in paths]
        for r in gone:
            self.spark.sql(f"DROP TABLE {r.table_name}")
        discard(*gone)

    def known(self, fresh: DataFrame) -> DataFrame:
        """The rows of all runs whose trigger is among those of fresh: one merge join with each run, which stays where it is."""
        keys = fresh.select("g").repartition(self.buckets, "g").distinct()
        met = [r.hint("merge").join(keys, "g", "left_semi").select(*_RUN) for r in self.runs]
        out = met[0]
        for m in met[1:]:
            out = out.unionAll(m)
        return out

    def add(self, batch: DataFrame, with_text: bool = False) -> DataFrame:
        """Deduplicate a batch (doc, doc_id, text) against itself and all earlier ones, and index it.

        A window of the batch is a repeat if it occurs in an earlier batch, or earlier in this one by (doc, start). An empty batch
        gives an empty result and an empty run.
        """
        if len(self.runs) > self.max_runs:
            self.compact()
        rows = stage(phrase_table(batch, WORDS), "op1-rows")
        both, texts, known = rows, batch.select("doc", F.lit(False).alias("old"), "text"), []
        if self.runs:
            if self.history is None:
                raise ValueError("an index that holds documents needs their texts")
            known = [stage(self.known(rows.where("g is not null")), "op1-known")]
            both = rows.unionByName(known[0].select("*", F.lit(1).alias("cnt"), F.lit(True).alias("old")))
            texts = texts.unionAll(self.history.select("doc", F.lit(True).alias("old"), "text"))
        ranges, fresh = repeated(both, texts, WORDS, keep_first=True, fresh=True)
        out = stage(finish(batch, ranges, WORDS, _kernel(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text), "op1-result")
        self._list([*self.paths, self._write(fresh.repartition(self.buckets, "g"))])
        self.history = batch.select("doc", "text") if self.history is None else self.history.unionAll(batch.select("doc", "text"))
        discard(rows, ranges, fresh, *known)
        return out

    def merged(self) -> DataFrame:
        """All runs as one, bucket by bucket: nothing is shuffled. Of equal fingerprints the earliest stays."""
        out = self.runs[0].select(*_RUN)
        for r in self.runs[1:]:
            out = out.unionAll(r.select(*_RUN))
        before = F.lag("c").over(Window.partitionBy("g").orderBy("c", "doc", "start"))
        return out.withColumn("before", before).where("before IS NULL OR before != c").drop("before")

    def compact(self) -> None:
        """Merge all runs into one."""
        self._list([self._write(self.merged())])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, max_runs: int = 1, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each input row; with_text adds the kept words.

    The table goes to an empty index in batches of ascending ids, whose runs are merged whenever there are more than max_runs. Null or empty text has no words; texts of under 20
    words stay whole. Rows that share an id are documents of their own, in the order of their texts; null ids come
    last. Other columns are ignored; an empty table gives an empty result.
    """
    rows, index = identified(docs, id_col, text_col), FingerprintIndex(docs.sparkSession, max_runs=max_runs)
    cuts = [None, *sorted(set(rows.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.001))), None] if batches > 1 else [None, None]
    parts = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        batch = rows
        batch = batch if low is None else batch.where(F.col("doc") > int(low))
        batch = batch if high is None else batch.where(F.col("doc") <= int(high))
        parts.append(index.add(batch, with_text))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))
