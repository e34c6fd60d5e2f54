"""What the operators share: scratch tables, Arrow access to texts, and vectorised hashing of bytes and words.

The numpy kernels work on the byte buffer of an Arrow batch, many documents at a time, in pieces of a
bounded number of bytes, so that a Python worker's memory does not depend on the batch or the corpus.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one vectorised step works on; a longer document is a step of its own.
PIECE_BYTES = 1 << 20

#: The white space of all contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local folder will do in local mode alone; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table in the shared folder and read it back: it cuts the lineage and outlives executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stage() that no later result reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write or replace a small file of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def clear_scratch(spark: SparkSession) -> None:
    """Delete all staged tables under the shared folder, once every result that reads them has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tidemark")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int | None = None) -> DataFrame:
    """left joined with right (staged; one row for each key; `rows`: how many rows of left have it), no hot key in one task.

    A key is hot if it has more than 1,000 rows and over a 10,000th of all. There are fewer than 10,000 such keys at any
    size, so they are broadcast and the rows of left that have them stay where they are. The others meet by a shuffle.
    """
    total = (right.agg(F.sum(rows)).first()[0] or 0) if total is None else total
    limit = max(1000, total // 10_000)
    cold = left.join(right.where(F.col(rows) <= limit), on)
    if total <= limit:
        return cold
    hot = F.broadcast(right.where(F.col(rows) > limit))
    return cold.unionByName(left.join(hot, on).select(cold.columns))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, those with the smallest hashes of a column; of a table that is much larger only about 2 n rows are sorted at all, however many tasks read it."""
    total, h = df.count(), F.xxhash64(F.col(key), F.lit(seed))
    if total > 4 * n:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * max(2 * n, n + 1000) / total))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(n)


def unused(columns: list[str], stem: str) -> str:
    """A column name that none of columns has, in any case."""
    taken, name = {c.lower() for c in columns}, f"_tidemark_{stem}"
    while name in taken:
        name += "_"
    return name


def frugal(run):
    """A function over Arrow batches that, once a task is done with it, gives the memory it has freed back to the system: an idle worker stays small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that have no copy on their path."""
    sc, parent = spark.sparkContext, Path(__file__).resolve().parents[2]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if parent in on_path or getattr(sc, "_tidemark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((parent / "tidemark").rglob("*.py")):
            z.write(f, f.relative_to(parent))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True


def arrow_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """Keep Arrow batches of whole texts and sets small, in rows and in bytes, unless the session has chosen sizes itself; ship the package."""
    ship_package(spark)
    limits = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limits[0]) == "10000":
        spark.conf.set(limits[0], str(rows))
    if spark.conf.get(limits[1], None) in ("67108864b", "64m", "64MB"):
        spark.conf.set(limits[1], size)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and int64 offsets of its rows; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to limit bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Poly:
    """Polynomial hashes modulo 2^64 of spans, from prefix sums; two objects with other seeds are independent."""

    def __init__(self, seed: int):
        base = int(mix(np.array([seed], np.uint64))[0]) | 1
        self.base = np.uint64(base)
        self.inverse = np.uint64(pow(base, -1, 1 << 64))
        self.codes = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1))
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            one = np.ones(n, np.uint64)
            one[1:] = self.base
            self.pow = np.multiply.accumulate(one)
            one[1:] = self.inverse
            self.ipow = np.multiply.accumulate(one)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if len(self.pow) <= n:
            self.grow(max(n + 1, 2 * len(self.pow)))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.pow[:n], out=out[1:])
        return out

    def of_bytes(self, buf: np.ndarray) -> np.ndarray:
        return self.prefix(self.codes[buf])

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.ipow[start])


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a piece, and each document's first word (one entry more than documents)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(col: str) -> "F.Column":
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")
