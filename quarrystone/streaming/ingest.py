"""File streams with fixed schemas, checkpoints, and batch recompute of what needs windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = ("trans_id string, store_id int, date_time string, change_type_id int, "
                "items array<struct<item_id:int,quantity:int>>, bopis_order_id string, channel string")
SNAPSHOT_SCHEMA = "id int, item_id int, employee_id int, store_id int, date_time string, quantity int"


def json_stream(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(folder)


def csv_stream(spark: SparkSession, folder: str, schema: str = SNAPSHOT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def expectations(df: DataFrame, name: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows pass; how many break each rule is reported with every micro-batch."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"),
                      *[F.count_if(~F.coalesce(test, F.lit(False))).alias(code) for code, test in rules.items()])


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """All files not seen yet, once, through ``batch``; the checkpoint remembers them."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def append_available(stream: DataFrame, checkpoint: str, path: str) -> None:
    """All new files appended to a parquet folder, each row exactly once."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(
        availableNow=True).start().awaitTermination()


def collect_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The result table of a stream that has read everything there is, kept in memory (small results)."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def hourly_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and their value by hour and type, on a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))


def distinct_events(events: DataFrame, key: list[str], late: str = "2 days") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(key) if events.isStreaming else timed.dropDuplicates(key)
