"""Structured Streaming over the change log: the live table as a streaming aggregate.

The sequence number decides which version is newest, so late or repeated rows cannot change the result and no watermark
is needed. State is one version for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.visibility import live
from ..schema import LOG


def read_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Follow a folder of Parquet log segments."""
    reader = spark.readStream.schema(LOG).option("recursiveFileLookup", "true")
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def live_table(log: DataFrame) -> DataFrame:
    """The live rows of a log stream, for the complete output mode; a batch log gives the same rows."""
    return live(log)


def changes(log: DataFrame) -> DataFrame:
    """The newest version of each key that a trigger changed, tombstones too, for the update output mode."""
    return log.groupBy("cf", "user_key").agg(F.max_by(F.struct("seq", "op", "value"), F.col("seq")).alias("v")).select("cf", "user_key", "v.seq", "v.op", "v.value")


def upsert_into(log: DataFrame, path: str, checkpoint: str):
    """Write each trigger's changes as a segment of its own; rerunning a trigger rewrites the same segment."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trigger={number:012d}")

    return changes(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
