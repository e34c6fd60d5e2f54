"""Runs, files, blocks and the catalog: statistics, pruning and replay as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import shared_bytes
from ..functions.prefix import numbered, range_of, running, sampled_cuts
from ..schema import DELETE, InvalidKeyOrder

#: A catalog of more files than this meets its probes by key ranges.
MAX_BROADCAST_FILES = 100_000


def file_stats(log: DataFrame, by: list[str]) -> DataFrame:
    """Properties of each file: entries, tombstones, key bounds, sequence bounds."""
    return log.groupBy(*by).agg(
        F.count("*").alias("num_entries"), F.sum((F.col("op") == DELETE).cast("long")).alias("num_deletes"),
        F.min("user_key").alias("smallest_key"), F.max("user_key").alias("largest_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def candidates(probes: DataFrame, files: DataFrame, most: int = MAX_BROADCAST_FILES, ranges: int = 128) -> DataFrame:
    """Probes (cf, user_key) with the files whose key range holds them.

    The catalog is counted: up to `most` files are broadcast, and no probe is shuffled. More are dealt to all key ranges they meet, and
    each probe to its one range, so that a probe meets the files of its range alone. The result is the same.
    """
    p, own = probes.alias("p"), [c for c in files.columns if c not in ("cf", *probes.columns)]
    inside = (F.col("p.cf") == F.col("f.cf")) & (F.col("p.user_key") >= F.col("f.smallest_key")) & (F.col("p.user_key") <= F.col("f.largest_key"))
    if files.limit(most + 1).count() <= most:
        return p.join(F.broadcast(files.alias("f")), inside).select("p.*", *(F.col(f"f.{c}") for c in own))
    cuts = sampled_cuts(files, "smallest_key", ranges)
    p = probes.withColumn("_range", range_of(F.col("user_key"), cuts)).alias("p")
    f = files.withColumn("_range", F.explode(F.sequence(range_of(F.col("smallest_key"), cuts), range_of(F.col("largest_key"), cuts)))).alias("f")
    return p.join(f, inside & (F.col("p._range") == F.col("f._range"))).select(*(F.col(f"p.{c}") for c in probes.columns), *(F.col(f"f.{c}") for c in own))


def overlapping(files: DataFrame, begin: str | None, end: str | None) -> DataFrame:
    """Files that meet the half-open key range [begin, end); a missing bound is none."""
    out = files if begin is None else files.where(F.col("largest_key") >= begin)
    return out if end is None else out.where(F.col("smallest_key") < end)


def blocks(log: DataFrame, by: list[str], block_bytes: int = 4096) -> DataFrame:
    """The index of a sorted file: entries in key order are cut in blocks of about block_bytes."""
    size = F.octet_length("user_key") + F.lit(8) + F.when(F.col("op") == DELETE, 0).otherwise(8)
    order = Window.partitionBy(*by).orderBy("user_key", F.desc("seq"))
    placed = log.withColumn("_bytes", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    return placed.withColumn("block_no", F.floor(F.col("_bytes") / block_bytes)).groupBy(*by, "block_no").agg(
        F.count("*").alias("num_entries"), F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"), F.sum(size.cast("long")).alias("block_bytes")
    )


def live_files(edits: DataFrame) -> DataFrame:
    """Fold the edit log: the last action on each file decides; within one edit, deletions come before additions."""
    last = F.max_by(F.struct("kind", "smallest_key", "largest_key", "file_size"), F.struct("edit_id", (F.col("kind") == "add_file").cast("int")))
    return edits.where(F.col("kind").isin("add_file", "delete_file")).groupBy("cf", "level", "file_number").agg(last.alias("v")).where("v.kind = 'add_file'").select("cf", "level", "file_number", "v.smallest_key", "v.largest_key", "v.file_size")


def families(edits: DataFrame) -> DataFrame:
    """The catalog of column families: the last add or drop of each."""
    last = F.max_by(F.struct("kind", "cf_name"), F.col("edit_id"))
    return edits.where(F.col("kind").isin("add_cf", "drop_cf")).groupBy("cf").agg(last.alias("v")).select("cf", "v.cf_name", (F.col("v.kind") == "drop_cf").alias("dropped"))


def counters(edits: DataFrame) -> DataFrame:
    """The counters after replay: each only ever grows."""
    return edits.agg(F.max("next_file_number").alias("next_file_number"), F.max("last_sequence").alias("last_sequence"), F.max("edit_id").alias("last_edit"), F.count("*").alias("num_edits"))


def segments(log: DataFrame, threshold: int) -> DataFrame:
    """Cut each family's log in memtable segments of about threshold bytes, in sequence order."""
    size = (F.octet_length("user_key") + F.lit(8 + 1 + 48) + F.when(F.col("op") == DELETE, 0).otherwise(8)).cast("long")
    used = running(log.withColumn("bytes", size), ["cf"], "seq", "bytes", "used")
    return used.withColumn("segment", F.floor((F.col("used") - F.col("bytes")) / threshold))


def order_violations(log: DataFrame) -> DataFrame:
    """Entries whose key is not above the one before, per file in arrival order."""
    before = F.lag("user_key").over(Window.partitionBy("cf", "file_no").orderBy("seq"))
    return log.withColumn("previous_key", before).where(F.col("previous_key") >= F.col("user_key"))


def check_sorted(log: DataFrame) -> DataFrame:
    """The log itself, if the keys of each of its files rise strictly in arrival order; an error if not."""
    bad = order_violations(log).select("cf", "file_no", "user_key").limit(1).collect()
    if bad:
        raise InvalidKeyOrder(f"family {bad[0].cf}, file {bad[0].file_no}: {bad[0].user_key!r} is not above the key before it")
    return log


def shared_prefixes(keys: DataFrame, restart: int = 16, ranges: int = 128) -> DataFrame:
    """Prefix compression of sorted keys (cf, user_key): bytes shared with the key before, none at a restart; keys of any length."""
    placed = numbered(keys, ["cf"], "user_key", "entry", "_previous", ranges)
    at_restart = (F.col("entry") % restart == 0) | F.col("_previous").isNull()
    out = placed.withColumn("shared", F.when(at_restart, 0).otherwise(shared_bytes(F.col("user_key"), F.col("_previous"))))
    return out.select("cf", "user_key", "entry", "shared", (F.octet_length("user_key") - F.col("shared")).alias("non_shared"))
