"""Streaming forms of the time-based operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_stream(spark, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hours by event type; an hour is final once the watermark passes it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("hour"), "event_type", "n", "mean")


def sliding_mean(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Seven-hour means each hour."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "7 hours", "1 hour"), "event_type")
    return w.agg(F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "mean")


def scarcity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of events of a user without a gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def without_repeats(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events once each, repeats within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def after_warm_up(events: DataFrame, start: str) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(start).cast("timestamp"))


def append_batches(df: DataFrame, path: str, checkpoint: str):
    """Each batch into a folder of its own number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def batch_numbers(spark, path: str) -> list[int]:
    """The numbers of the batches that append_batches() has written, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(where) if s.getPath().getName().startswith("batch="))
