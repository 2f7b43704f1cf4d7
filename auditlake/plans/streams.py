"""Streams over the event table, run to the end of what has arrived."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from auditlake.functions.exprs import day_text
from auditlake.plans import Registry
from auditlake.plans.shapes import mean
from auditlake.session import scratch_path
from auditlake.sources.tables import load
from auditlake.streaming import jobs

REG = Registry()


def _stream(spark, d):
    return jobs.open_stream(spark, f"{d}/events.parquet*", load(spark, d, "events").schema, "ts")


def _finish(spark, stream, label, run=jobs.run_available):
    path, mark = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    run(stream, path, mark)
    return spark.read.schema(stream.schema).parquet(path)


@REG.add(
    "j1_velocity_stream",
    """
    WITH w AS (SELECT user_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS window_start
               FROM events, range(24) r(k))
    SELECT CAST(window_start AS TIMESTAMP) AS window_start, user_id, count(*) AS tx_count FROM w
    WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
    GROUP BY 1, 2 HAVING count(*) > 5
    """,
)
def j1(spark, d):
    alerts = jobs.velocity_alerts(_stream(spark, d), "user_id", "ts", "24 hours", "1 hour", "2 hours", 5)
    return _finish(spark, alerts, "velocity")


@REG.add(
    "j1_instant_alerts",
    """
    WITH i AS (SELECT user_id, ts AS instant, count(*) AS n FROM events GROUP BY 1, 2),
         w AS (SELECT user_id, instant, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY instant
                   RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_count FROM i)
    SELECT * FROM w WHERE tx_count > 5
      AND instant < date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 2 HOUR
    """,
)
def j1_instants(spark, d):
    found = jobs.instant_alerts(_stream(spark, d), "user_id", "ts", dt.timedelta(hours=24), "2 hours", 5)
    return _finish(spark, found, "instants")


@REG.add(
    "j2_dedupe_stream",
    "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def j2(spark, d):
    rows = _stream(spark, d).withColumn("day", day_text("ts"))
    once = jobs.suppress_duplicates(rows, ["user_id", "event_type", "day"], "ts", "24 hours", "event_id")
    return _finish(spark, once.select("user_id", "event_type", "day"), "dedupe")


@REG.add(
    "j3_usage_stream",
    f"""
    SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2000-01-01') AS bucket, count(*) AS requests,
           count(*) FILTER (WHERE event_type = 'error') AS errors, {mean('value')} AS avg_time
    FROM events GROUP BY 1
    HAVING bucket + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
    """,
)
def j3(spark, d):
    metrics = jobs.usage_metrics(_stream(spark, d), "ts", F.col("event_type") != "error", "value")
    return _finish(spark, metrics, "usage", jobs.run_batches).drop("batch")
