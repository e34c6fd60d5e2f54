"""A block cache in shards of least-recently-used blocks, replayed over an access log."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 16


def shard_of(file_no: "F.Column", offset: "F.Column") -> "F.Column":
    """The shard of a block: file number xor the offset rotated left by 17, modulo the shards."""
    rotated = F.shiftleft(offset, 17).bitwiseOR(F.shiftrightunsigned(offset, 47))
    return file_no.bitwiseXOR(rotated).bitwiseAND(F.lit(SHARDS - 1)).cast("int")


def simulate(accesses: DataFrame, capacity: int) -> DataFrame:
    """shard, accesses, hits, evictions of accesses (at: a unique long, file_no, offset), each shard holding `capacity` blocks.

    What a shard holds depends on all accesses before, so a shard is one task's; its state is `capacity` blocks, and it streams its accesses in order.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, counts = None, OrderedDict(), [0, 0, 0]

        def row() -> pd.DataFrame:
            return pd.DataFrame([[shard, *counts]], columns=["shard", "accesses", "hits", "evictions"])

        for f in frames:
            for own, file_no, offset in zip(f["shard"], f["file_no"], f["offset"]):
                if own != shard:
                    if shard is not None:
                        yield row()
                    shard, held, counts = own, OrderedDict(), [0, 0, 0]
                counts[0] += 1
                block = (file_no, offset)
                if block in held:
                    counts[1] += 1
                    held.move_to_end(block)
                    continue
                if len(held) >= capacity:
                    held.popitem(last=False)
                    counts[2] += 1
                held[block] = None
        if shard is not None:
            yield row()

    placed = accesses.select("at", "file_no", "offset", shard_of(F.col("file_no"), F.col("offset")).alias("shard"))
    return placed.repartition("shard").sortWithinPartitions("shard", "at").mapInPandas(run, "shard int, accesses long, hits long, evictions long")
