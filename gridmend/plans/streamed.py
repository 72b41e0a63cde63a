"""Queries that run streams over the events table to their end; each must give what one batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import scratch_path
from ..streaming import latch, timeline
from .catalog import query
from .views import Tables

R = F.round


def events(t: Tables) -> DataFrame:
    path = f"{t.folder}/events.parque[t]"  # a pattern: the table may be a folder or one file, which a stream can't read by its name
    return timeline.events_stream(t.spark, path, t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str, out: str | None = None) -> DataFrame:
    """What a stream has written when its input is used up: in complete mode its last batch, else all batches. ``out``: where it goes on
    from what it has written before."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream")
    timeline.append_batches(stream, f"{out}/data", f"{out}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    numbers = timeline.batch_numbers(spark, f"{out}/data")
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{out}/data/batch={n}" for n in (numbers[-1:] if mode == "complete" else numbers)))


@query("R02 A32", "select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def stream_hourly(t: Tables) -> DataFrame:
    x = finished(timeline.hourly(events(t)), "complete")
    return x.select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", R("mean", 6).alias("mean"))


@query("R04 W05", """select event_type, strftime(start, '%Y-%m-%d %H:%M:%S') as start, round(avg(value), 6) as mean from (select event_type, value, date_trunc('hour', ts) - to_hours(h) as start from events, range(0, 7) r(h)) group by 1, 2""")
def stream_sliding(t: Tables) -> DataFrame:
    x = finished(timeline.sliding_mean(events(t)), "complete")
    return x.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), R("mean", 6).alias("mean"))


@query("R03", """with x as (select user_id, ts, value, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as first from events), s as (select *, sum(first) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from x)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def stream_sessions(t: Tables) -> DataFrame:
    x = finished(timeline.scarcity_sessions(events(t)), "complete")
    return x.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n", R("total", 4).alias("total"))


@query("R05 R06 R07 A13", "select event_id, user_id from events where ts >= timestamp '2024-01-15'")
def stream_without_repeats(t: Tables) -> DataFrame:
    twice = timeline.after_warm_up(events(t).unionByName(events(t)), "2024-01-15")
    return finished(timeline.without_repeats(twice, ["event_id"], "40 days"), "append").select("event_id", "user_id")


@query("R01 R03 (calls held by a latch)", """with x as (select user_id, epoch_us(ts) as us, value, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 86400000000 then 0 else 1 end as first from events where value >= 60), s as (select *, sum(first) over (partition by user_id order by us rows between unbounded preceding and current row) as k from x)
select user_id as key, min(us) as opened_us, max(us) + 86400000000 as closed_us, count(*) as shortages, round(max(value), 6) as peak from s group by user_id, k""")
def stream_shortage_calls(t: Tables) -> DataFrame:
    """Shortages of each user open calls that are held for a day. The log comes in three parts by time, and one that ends it; the stream
    takes each as one batch, of as many files as tasks have written, and goes on from its checkpoint with the next."""
    source, out = scratch_path(t.spark, "log"), scratch_path(t.spark, "stream")
    log = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    cuts = ["2000-01-01", "2024-01-10", "2024-01-20", "2100-01-01"]
    parts = [log.where((F.col("ts") >= F.lit(begins).cast("timestamp")) & (F.col("ts") < F.lit(ends).cast("timestamp"))) for begins, ends in zip(cuts, cuts[1:], strict=False)]
    end = log.groupBy("user_id").agg(F.max("ts").alias("ts")).select("user_id", (F.col("ts") + F.expr("interval 1 second")).alias("ts"), F.lit(None).cast("double").alias("value"))
    last = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    parts.append(end.join(last).select("user_id", F.greatest("ts", F.col("last")).alias("ts"), "value"))
    with latch.with_rocks(t.spark):
        for part in parts:
            part.write.mode("append").parquet(source)
            rows = timeline.events_stream(t.spark, source, log.schema, files_per_trigger=1_000_000)
            x = finished(latch.shortage_calls(rows, "user_id", "ts", "value", 60.0, 86_400_000_000), "append", out)
    return x.select("key", "opened_us", "closed_us", "shortages", R("peak", 6).alias("peak"))
