"""Streams over files against the same computation in one batch."""

import pytest
from pyspark.sql import functions as F

from gridmend.streaming import latch, timeline


@pytest.fixture(scope="module")
def stream(spark, small, tmp_path_factory):
    source = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for day in ("2024-01-10", "2024-01-20", "2024-03-01"):  # one file after another, so that a stream meets them in order of time
        begun = {"2024-01-10": "2023-01-01", "2024-01-20": "2024-01-10", "2024-03-01": "2024-01-20"}[day]
        events.where(f"ts >= '{begun}' and ts < '{day}'").orderBy("ts").coalesce(1).write.mode("append").parquet(source)
    return events, lambda: timeline.events_stream(spark, source, events.schema)


def run(df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_hourly(stream):
    events, make = stream
    got = run(timeline.hourly(make()), "hourly_out")
    want = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert got.select("hour", "event_type", "n").exceptAll(want).count() == 0 and got.count() == want.count()


def test_sessions(stream):
    events, make = stream
    got = run(timeline.scarcity_sessions(make()), "sessions_out", "append")
    want = events.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    final = want.select("user_id", F.col("session_window.start").alias("start"), "n")
    assert got.count() > 0 and got.select("user_id", "start", "n").exceptAll(final).count() == 0


def test_repeats_and_warm_up(stream):
    events, make = stream
    twice = make().unionByName(make())
    got = run(timeline.without_repeats(twice, ["event_id"], "40 days"), "repeats_out", "append")
    assert got.count() == events.count()
    late = timeline.after_warm_up(events, "2024-01-15")
    assert 0 < late.count() < events.count()


def test_batches_replace_themselves(spark, stream, tmp_path):
    events, make = stream
    q = timeline.append_batches(make(), f"file://{tmp_path}/out", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == events.count()


def calls_of(rows, hold):
    out = []
    for key in sorted({k for k, _, _ in rows}):
        own = latch.merged([(t, t, 1, x) for k, t, x in rows if k == key and x >= 5], hold)
        out += [(key, a, b + hold, n, peak) for a, b, n, peak in own]
    return sorted(out)


def test_a_latch_with_a_restart_gives_what_one_batch_gives(spark, tmp_path):
    hour = 3_600_000_000
    first = [(1, 0, 7.0), (1, 30, 3.0), (1, 40, 9.0), (2, 10, 6.0), (1, 400, 5.0), (2, 100, 1.0)]
    second = [(1, 460, 8.0), (2, 420, 6.5), (1, 410, 6.0), (1, 2000, 5.5), (2, 2000, 1.0)]  # out of order, but not late
    third = [(1, 100, 99.0), (2, 2100, 7.0)]  # the first is late
    minutes = lambda rows: [(k, 1_700_000_000_000_000 + m * 60_000_000, x) for k, m, x in rows]
    source, out = f"{tmp_path}/source", f"{tmp_path}/out"

    def put(rows):
        df = spark.createDataFrame(rows, "key long, us long, x double").select("key", F.timestamp_micros("us").alias("ts"), "x")
        df.coalesce(1).write.mode("append").parquet(source)
        return df.schema

    def go(schema):
        with latch.with_rocks(spark):
            calls = latch.shortage_calls(timeline.events_stream(spark, source, schema), "key", "ts", "x", 5.0, hour)
            q = calls.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)

    for rows in (first, second, third):
        schema = put(minutes(rows))
        go(schema)  # each time from the checkpoint
    put(minutes([(k, 2300, None) for k in (1, 2)]))
    go(schema)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == calls_of(minutes(first + second + third[1:]), hour)


def test_the_log_of_shortages_is_written_by_many_tasks(spark, small, monkeypatch):
    """Each part of the log is one batch, however many files it has, and a key without calls to tell costs no rows."""
    from gridmend.plans import QUERIES, streamed

    files, real = [], timeline.events_stream

    def seen(spark, source, schema, **more):
        files.append(len(spark.read.parquet(source).inputFiles()))
        return real(spark, source, schema, **more)

    monkeypatch.setattr(streamed.timeline, "events_stream", seen)
    monkeypatch.setattr(streamed.Tables, "__getattr__", lambda t, name: t.spark.read.parquet(f"{t.folder}/{name}.parquet").repartition(3))
    got = QUERIES["stream_shortage_calls"](spark, small)
    events = spark.read.parquet(f"{small}/events.parquet").where("value >= 60")
    assert got.agg(F.sum("shortages")).first()[0] == events.count()
    assert files[0] == 3 and len(files) == 4
