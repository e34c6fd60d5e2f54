"""Compaction: which versions of the inputs the output keeps, and merge functions on values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, PUT
from .visibility import KEY, at_snapshot, stripe

#: Operands of one key within so many sequence numbers are folded together before they meet the others.
FOLD_WIDTH = 1 << 16


@dataclass(frozen=True)
class MergeOperator:
    """How the values of a key's puts become one: `step` folds a value into what the earlier ones gave; the first value is `start` of itself.

    `join`, if there is one, joins what two stretches of operands gave, in order: then a key's history is folded in ranges, and a
    compaction may replace a stretch by what it gives. Without it the operands of a key meet in one row, and only reads fold.
    """

    name: str
    step: Callable[[Column, Column], Column]
    start: Callable[[Column], Column] = lambda v: v
    join: Callable[[Column, Column], Column] | None = None

    def fold(self, values: Column) -> Column:
        """values: an array, in order, not empty."""
        return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), self.start(F.element_at(values, 1)), self.step)

    def fold_joined(self, parts: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), self.join)


#: Values are binary: the newer one is put behind the older.
APPEND = MergeOperator("append", lambda a, v: F.concat(a, v), join=lambda a, b: F.concat(a, b))


def compact(log: DataFrame, snapshots: list[int] | None = None, bottom: bool = False, merge: MergeOperator | None = None) -> DataFrame:
    """The newest version of each key in each stripe between live snapshots; no scan at a live snapshot changes.

    At the bottom level, tombstones of the oldest stripe hide nothing and go too. With a merge function that can join, the puts of a stripe
    after its last tombstone become one, and that tombstone stays before them (but at the bottom), for it cuts off what is older.
    """
    cut = sorted(snapshots or [])
    lowest = cut[0] if cut else (1 << 63) - 1
    striped = log.withColumn("_stripe", stripe(F.col("seq"), cut))
    hidden = (F.col("_stripe") == lowest) & (F.col("op") == DELETE) if bottom else F.lit(False)
    if merge is None:
        top = F.max_by(F.struct("seq", "op", "value"), F.col("seq")).alias("v")
        kept = striped.groupBy(*KEY, "_stripe").agg(top).select(*KEY, "_stripe", "v.seq", "v.op", "v.value")
        return kept.where(~hidden).select(*KEY, "seq", "op", "value")
    if merge.join is None:
        raise ValueError(f"{merge.name} cannot join what two stretches give")
    dead = striped.where(F.col("op") == DELETE).groupBy(*KEY, "_stripe").agg(F.max("seq").alias("seq")).withColumn("op", F.lit(DELETE)).withColumn("value", F.lit(None).cast(log.schema["value"].dataType))
    puts = _folded(operands(striped, ["_stripe"]), [*KEY, "_stripe"], merge).select(*KEY, "_stripe", "seq", F.lit(PUT).alias("op"), F.col("merged").alias("value"))
    return dead.select(*KEY, "_stripe", "seq", "op", "value").unionByName(puts).where(~hidden).select(*KEY, "seq", "op", "value")


def operands(log: DataFrame, also: list[str] | None = None) -> DataFrame:
    """The puts of each key after its newest tombstone (in each group of `also`): what a merge function folds."""
    by = [*KEY, *(also or [])]
    cut = log.where(F.col("op") == DELETE).groupBy(*by).agg(F.max("seq").alias("_cut"))
    return log.where(F.col("op") == PUT).join(cut, by, "left").where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut"))).drop("_cut")


def _folded(puts: DataFrame, by: list[str], merge: MergeOperator, width: int = FOLD_WIDTH) -> DataFrame:
    """seq (the last) and merged of each group, in order of sequence numbers."""
    values = lambda order, c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(c).alias("_v")))), lambda x: x["_v"])
    if merge.join is None:
        return puts.groupBy(*by).agg(F.max("seq").alias("seq"), values("seq", "value").alias("_all")).withColumn("merged", merge.fold(F.col("_all"))).drop("_all")
    near = puts.withColumn("_range", F.floor(F.col("seq") / width)).groupBy(*by, "_range").agg(F.max("seq").alias("seq"), values("seq", "value").alias("_all")).withColumn("_part", merge.fold(F.col("_all")))
    return near.groupBy(*by).agg(F.max("seq").alias("seq"), values("_range", "_part").alias("_parts")).withColumn("merged", merge.fold_joined(F.col("_parts"))).drop("_parts")


def merged(log: DataFrame, merge: MergeOperator, snapshot: int | None = None) -> DataFrame:
    """What a reader of a family with a merge function sees at a snapshot: cf, user_key, seq (of the last operand), value."""
    return _folded(operands(at_snapshot(log, snapshot)), KEY, merge).select(*KEY, "seq", F.col("merged").alias("value"))


def merge_sum(log: DataFrame) -> DataFrame:
    """An associative and commutative merge: exact sums in cents, combined before the exchange."""
    cents = F.round(F.col("value") * 100).cast("long")
    return operands(log).groupBy(*KEY).agg(F.sum(cents).alias("cents"), F.count("*").alias("n_operands"))


def merge_fold(log: DataFrame, start, step) -> DataFrame:
    """An order-dependent merge: fold step over the values of a key's operands by sequence number, from start. A key's operands meet in one row, as such a fold must."""
    merge = MergeOperator("fold", step, lambda v: step(start, v))
    return merged(log, merge).select(*KEY, F.col("value").alias("folded"))


def merge_append(log: DataFrame) -> DataFrame:
    """Appends the values of the operands (strings), in order, with commas; a key's history is joined by ranges."""
    comma = lambda a, b: F.concat(a, F.lit(","), b)
    return merged(log, MergeOperator("list", comma, join=comma)).select(*KEY, F.col("value").alias("appended"))
