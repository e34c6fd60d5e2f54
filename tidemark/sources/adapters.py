"""Tables as change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_ENTRIES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cf, user_key, seq, op, value, batch_id, ordinal, file_no: an error is a delete, all else a put."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    gone = F.col("event_type") == "error"
    return e.select(
        (F.col("user_id") % 2).cast("int").alias("cf"), F.format_string("%012d", "user_id").alias("user_key"), (F.col("event_id") + 1).alias("seq"),
        F.when(gone, 1).otherwise(0).alias("op"), F.when(~gone, F.col("value")).alias("value"),
        F.expr("event_id div 8").alias("batch_id"), (F.col("event_id") % 8).alias("ordinal"), F.expr(f"event_id div {FILE_ENTRIES} + 1").alias("file_no"),
    )


def edit_log(files: DataFrame) -> DataFrame:
    """Catalog edits of a life of these files (cf, file_no, ...): each is added to level 0; every fourth edit moves four to level 1 as one; families are added, one is dropped."""
    none = lambda t: F.lit(None).cast(t)
    add = files.select((F.col("file_no") * 4).alias("edit_id"), "cf", F.lit("add_file").alias("kind"), F.lit(0).alias("level"), F.col("file_no").alias("file_number"), "smallest_key", "largest_key", (F.col("num_entries") * 20).alias("file_size"), none("string").alias("cf_name"), (F.col("file_no") + 1).alias("next_file_number"), F.col("max_seq").alias("last_sequence"))
    group = F.expr("(file_no - 1) div 4")
    full = files.withColumn("g", group)
    whole = full.groupBy("cf", "g").agg(F.count("*").alias("n"), F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"), F.sum(F.col("num_entries") * 20).alias("file_size"), F.max("max_seq").alias("last_sequence")).where("n = 4")
    at = (F.col("g") * 16 + 18).alias("edit_id")
    gone = full.join(whole.select("cf", "g"), ["cf", "g"]).select(at, "cf", F.lit("delete_file").alias("kind"), F.lit(0).alias("level"), F.col("file_no").alias("file_number"), none("string").alias("smallest_key"), none("string").alias("largest_key"), none("long").alias("file_size"), none("string").alias("cf_name"), none("long").alias("next_file_number"), none("long").alias("last_sequence"))
    new = whole.select(at, "cf", F.lit("add_file").alias("kind"), F.lit(1).alias("level"), (F.lit(100_000) + F.col("g")).alias("file_number"), "smallest_key", "largest_key", "file_size", none("string").alias("cf_name"), (F.lit(100_001) + F.col("g")).alias("next_file_number"), "last_sequence")
    cfs = files.sparkSession.createDataFrame([(1, 0, "add_cf", "cf_user"), (2, 1, "add_cf", "cf_system"), (3, 2, "add_cf", "scratch"), (9, 2, "drop_cf", None)], "edit_id long, cf int, kind string, cf_name string")
    fam = cfs.select("edit_id", "cf", "kind", none("int").alias("level"), none("long").alias("file_number"), none("string").alias("smallest_key"), none("string").alias("largest_key"), none("long").alias("file_size"), "cf_name", none("long").alias("next_file_number"), none("long").alias("last_sequence"))
    return add.unionByName(gone).unionByName(new).unionByName(fam)
