"""Continuous velocity alerts, duplicate suppression and usage metrics.

All three use event time with a watermark and append mode: a result is emitted
once, when its window can no longer change.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from auditlake.functions.exprs import count_if, mean_of, micros
from auditlake.operators.transactions import VELOCITY_MIN_ROWS

DEDUPE_SALTS = 16


def open_stream(
    spark: SparkSession, path: str, schema: StructType, ts: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A folder of parquet files as a stream; its time column becomes an event time."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def velocity_alerts(
    stream: DataFrame,
    user: str,
    ts: str,
    window: str = "1 hour",
    slide: str = "5 minutes",
    watermark: str = "2 hours",
    min_n: int = VELOCITY_MIN_ROWS,
) -> DataFrame:
    """Users with more than ``min_n`` rows in a sliding window."""
    counts = (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window, slide).alias("w"), F.col(user))
        .agg(F.count("*").alias("tx_count"))
    )
    return counts.filter(F.col("tx_count") > min_n).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), user, "tx_count"
    )


def instant_alerts(
    stream: DataFrame,
    user: str,
    ts: str,
    window: dt.timedelta = dt.timedelta(hours=1),
    watermark: str = "2 hours",
    min_n: int = VELOCITY_MIN_ROWS,
) -> DataFrame:
    """(user, instant, tx_count): every instant with more than ``min_n`` rows in the window that ends there.

    The stream form of ``velocity_all``: no slide, each instant is judged by its own
    trailing window, once the watermark has passed it and its rows are complete. A
    user's state is the times of one window and those not yet judged; a timer at
    event time judges what becomes due without new rows, and drops the state when
    the last window has gone by. Rows behind the watermark count for nothing.
    """
    size = int(window.total_seconds() * 1_000_000)

    def judge(key, frames, state):
        import numpy as np
        import pandas as pd

        kept, waiting = (np.array(x, np.int64) for x in state.get) if state.exists else (np.empty(0, np.int64), np.empty(0, np.int64))
        waiting = np.sort(np.concatenate([waiting, *(f["_t"].to_numpy(np.int64) for f in frames)]))
        mark = state.getCurrentWatermarkMs()
        now = mark * 1000
        due, rest = waiting[waiting <= now], waiting[waiting > now]
        times = np.sort(np.concatenate((kept, due)))
        instants = np.unique(due)
        inside = np.searchsorted(times, instants, "right") - np.searchsorted(times, instants - size, "left")
        # Later instants are past the watermark, so their windows begin past this.
        kept = times[times > now - size]
        if len(kept) or len(rest):
            state.update((kept.tolist(), rest.tolist()))
            following = rest[0] if len(rest) else kept[-1] + size
            state.setTimeoutTimestamp(int(max(following // 1000, mark + 1)))
        elif state.exists:
            state.remove()
        over = inside > min_n
        yield pd.DataFrame({user: [key[0]] * int(over.sum()), "_t": instants[over], "tx_count": inside[over]})

    marked = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark).select(user, ts, micros(ts).alias("_t"))
    out = StructType([stream.schema[user]]).add("_t", "long").add("tx_count", "long")
    judged = marked.groupBy(user).applyInPandasWithState(
        judge, out, "kept array<bigint>, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return judged.select(user, F.timestamp_micros("_t").cast("timestamp_ntz").alias("instant"), "tx_count")


def suppress_duplicates(
    stream: DataFrame, keys: list[str], ts: str, watermark: str, spread_by: str | None = None
) -> DataFrame:
    """The first row of each key; repeats within the watermark are dropped.

    With ``spread_by`` a key is first reduced in up to DEDUPE_SALTS tasks, so a
    key holding much of the input does not reach one task as a whole.
    """
    marked = stream.withWatermark(ts, watermark)
    if spread_by is None:
        return marked.dropDuplicatesWithinWatermark(keys)
    salted = marked.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(DEDUPE_SALTS)))
    once = salted.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return once.dropDuplicatesWithinWatermark(keys)


def usage_metrics(
    stream: DataFrame, ts: str, ok: Column, duration: str, bucket: str = "2 hours", watermark: str = "2 hours"
) -> DataFrame:
    """Requests, errors and mean duration per tumbling bucket; rows behind the watermark are dropped."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, bucket).alias("w"))
        .agg(
            F.count("*").alias("requests"),
            count_if(~ok).alias("errors"),
            mean_of(duration).alias("avg_time"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "requests", "errors", "avg_time")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, into a parquet sink with its own commit log."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived batch by batch; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

