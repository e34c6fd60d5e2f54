"""Which versions a reader sees: the one place that knows about newest versions and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE

KEY = ["cf", "user_key"]


def at_snapshot(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones too: cf, user_key, seq, op, value.

    A mergeable aggregate, so a hot key is combined before the exchange; filters on the key and the sequence reach the scan.
    """
    top = F.max_by(F.struct("seq", "op", "value"), F.col("seq")).alias("v")
    return at_snapshot(log, snapshot).groupBy(*KEY).agg(top).select(*KEY, "v.seq", "v.op", "v.value")


def live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The state a snapshot sees: cf, user_key, seq, value. The tombstone is tested after the newest version is chosen."""
    return newest(log, snapshot).where(F.col("op") != DELETE).select(*KEY, "seq", "value")


def versions(log: DataFrame) -> DataFrame:
    """All versions with their rank within the key, newest first; a tombstone goes before a put of the same sequence number."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("seq"), F.desc("op"))
    return log.withColumn("version_rank", F.row_number().over(order))


def asof(requests: DataFrame, log: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Each request (request_id, cf, user_key, at_seq) with the version that its snapshot sees: found_seq and value, null if none.

    Requests and versions are laid in one order and cut by ranges of sequence numbers, so a hot key's history is
    shared out; what a range inherits comes from a window over one row for each key and range.
    """
    version = F.when(F.col("seq").isNotNull(), F.struct("seq", "op", "value"))
    wide = requests.select("request_id", *KEY, "at_seq", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("op"), F.lit(None).cast(log.schema["value"].dataType).alias("value"))
    rows = wide.unionByName(log.select(F.lit(None).cast("long").alias("request_id"), *KEY, F.col("seq").alias("at_seq"), "seq", "op", "value"))
    rows = rows.withColumn("v", version).withColumn("_range", F.floor(F.col("at_seq") / width))
    inside = Window.partitionBy(*KEY, "_range").orderBy("at_seq", F.col("request_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("own", F.last("v", ignorenulls=True).over(inside)).where("request_id is not null")
    ends = log.groupBy(*KEY, F.floor(F.col("seq") / width).alias("_from")).agg(F.max_by(F.struct("seq", "op", "value"), F.col("seq")).alias("last"))
    marks = ends.select(*KEY, F.col("_from").alias("_range"), "last").unionByName(near.select(*KEY, "_range").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType)))
    merged = marks.groupBy(*KEY, "_range").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = Window.partitionBy(*KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inherited = merged.withColumn("old", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    seen = near.join(inherited, [*KEY, "_range"], "left").withColumn("s", F.coalesce("own", "old"))
    here = F.col("s.op") != DELETE
    return seen.select("request_id", *KEY, "at_seq", F.when(here, F.col("s.seq")).alias("found_seq"), F.when(here, F.col("s.value")).alias("value"))


def stripe(seq: Column, snapshots: list[int]) -> Column:
    """The smallest live snapshot that sees a version; the largest long if only later readers do."""
    out = F.lit((1 << 63) - 1)
    for s in sorted(snapshots, reverse=True):
        out = F.when(seq <= s, F.lit(s).cast("long")).otherwise(out)
    return out
