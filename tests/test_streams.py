"""Streams over time-ordered files with late rows, against their batch form."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import transactions
from auditlake.sources.tables import load
from auditlake.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The event table as six files in time order, a late row, and a last row far ahead."""
    base = tempfile.mkdtemp(prefix="run-stream-")
    df = load(spark, sf_dir, "events")
    start = dt.datetime(2024, 1, 1)
    for i in range(6):
        lo, hi = start + dt.timedelta(days=5 * i), start + dt.timedelta(days=5 * (i + 1))
        df.filter((F.col("ts") >= str(lo)) & (F.col("ts") < str(hi))).coalesce(1).write.mode("append").parquet(base)
    extra = df.limit(1)
    late = extra.withColumn("ts", F.lit("2024-01-02 03:00:00").cast("timestamp_ntz")).withColumn("user_id", F.lit(-1).cast("bigint"))
    late.coalesce(1).write.mode("append").parquet(base)
    end = extra.withColumn("ts", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).withColumn("user_id", F.lit(-2).cast("bigint"))
    end.coalesce(1).write.mode("append").parquet(base)
    return base


def finish(spark, stream, run=jobs.run_available):
    out, mark = tempfile.mkdtemp(prefix="run-out-") + "/t", tempfile.mkdtemp(prefix="run-mark-")
    run(stream, out, mark)
    return spark.read.schema(stream.schema).parquet(out)


def test_usage_equals_batch(spark, sf_dir, parts):
    source = jobs.open_stream(spark, parts, load(spark, sf_dir, "events").schema, "ts", files_per_trigger=1)
    ok = F.col("event_type") != "error"
    got = finish(spark, jobs.usage_metrics(source, "ts", ok, "value"), jobs.run_batches)
    batch = (
        load(spark, sf_dir, "events")
        .groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours").alias("w"))
        .agg(F.count("*").alias("requests"), F.count(F.when(~ok, 1)).alias("errors"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "requests", "errors")
    )
    mine = got.filter("bucket < '2024-05-01'").select("bucket", "requests", "errors")
    # Every window closed; the row behind the watermark changed none of them.
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, batch.collect()))


def test_velocity_equals_batch(spark, sf_dir, parts):
    source = jobs.open_stream(spark, parts, load(spark, sf_dir, "events").schema, "ts", files_per_trigger=1)
    got = finish(spark, jobs.velocity_alerts(source, "user_id", "ts", "12 hours", "6 hours", "2 hours", 3))
    batch = (
        load(spark, sf_dir, "events")
        .groupBy(F.window(F.col("ts").cast("timestamp"), "12 hours", "6 hours").alias("w"), "user_id")
        .agg(F.count("*").alias("tx_count"))
        .filter("tx_count > 3")
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "user_id", "tx_count")
    )
    assert batch.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_instants_equal_the_sliding_velocity(spark, sf_dir, parts):
    """All windows closed by the last row; the late row is dropped; a timer judges what no later row of the user does."""
    source = jobs.open_stream(spark, parts, load(spark, sf_dir, "events").schema, "ts", files_per_trigger=1)
    window = dt.timedelta(hours=12)
    got = finish(spark, jobs.instant_alerts(source, "user_id", "ts", window, "2 hours", 2))
    batch = transactions.velocity_all(load(spark, sf_dir, "events"), "user_id", "ts", window, 2)
    assert batch.count() > 0 and got.filter("user_id < 0").count() == 0
    assert got.count() == got.select("user_id", "instant").distinct().count()
    mine = got.groupBy("user_id").agg(F.max("tx_count").alias("peak_count"), F.count("*").alias("instants_over"))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("spread_by", [None, "event_id"])
def test_duplicates_across_files(spark, sf_dir, parts, spread_by):
    source = jobs.open_stream(spark, parts, load(spark, sf_dir, "events").schema, "ts", files_per_trigger=1)
    rows = source.filter("user_id >= 0").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    once = jobs.suppress_duplicates(rows, ["user_id", "day"], "ts", "24 hours", spread_by)
    got = finish(spark, once.select("user_id", "day"))
    want = load(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_restart_does_not_repeat(spark, sf_dir, parts):
    out, mark = tempfile.mkdtemp(prefix="run-out-") + "/t", tempfile.mkdtemp(prefix="run-mark-")
    make = lambda: jobs.usage_metrics(
        jobs.open_stream(spark, parts, load(spark, sf_dir, "events").schema, "ts"), "ts",
        F.col("event_type") != "error", "value",
    )
    jobs.run_available(make(), out, mark)
    first = spark.read.parquet(out).count()
    jobs.run_available(make(), out, mark)
    assert spark.read.parquet(out).count() == first > 0
