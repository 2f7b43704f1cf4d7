"""Backdated, future-dated and out-of-order timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.exprs import count_if, micros, as_double, resolve_as_of, ts_lit, ts_text

# Thresholds of the detectors.
BACKDATED_DAYS, BACKDATED_MAX_DAYS, BACKDATED_MIN_ROWS = 7, 365, 10
FUTURE_MIN_ROWS = 5
INSERT_DAYS = 1
ROW_LIMIT = 100
DAY, HOUR = 86_400e6, 3_600e6


def _days(a: Column, b: Column) -> Column:
    return (micros(a) - micros(b)) / DAY


def _mean_days(total_micros: Column, n: Column, unit: float) -> Column:
    return as_double(total_micros.cast("double") / n / unit)


def backdated_summary(
    df: DataFrame, created: str, as_of: dt.datetime | str | None = None, min_n: int = BACKDATED_MIN_ROWS
) -> DataFrame:
    """Rows older than a week and younger than a year; no row unless more than ``min_n``."""
    now = resolve_as_of(df, created, as_of)
    if now is None:
        return _no_summary(df, "backdated_count", "earliest_backdate", "avg_days_back")
    kind = df.schema[created].dataType
    rows = df.filter(
        (F.col(created) < ts_lit(now - dt.timedelta(days=BACKDATED_DAYS), kind))
        & (F.col(created) > ts_lit(now - dt.timedelta(days=BACKDATED_MAX_DAYS), kind))
    )
    back = F.sum((micros(ts_lit(now, kind)) - micros(created)).cast("decimal(38,0)"))
    return rows.agg(
        F.count("*").alias("backdated_count"),
        ts_text(F.min(created)).alias("earliest_backdate"),
        _mean_days(back, F.count("*"), DAY).alias("avg_days_back"),
    ).filter(F.col("backdated_count") > min_n)


def _no_summary(df: DataFrame, count: str, text: str, mean: str) -> DataFrame:
    return df.agg(
        F.count("*").alias(count), F.lit(None).cast("string").alias(text), F.lit(None).cast("double").alias(mean)
    ).filter(F.lit(False))


def backdated_rows(
    df: DataFrame,
    created: str,
    inserted: str,
    key: str,
    as_of: dt.datetime | str | None = None,
    n: int = ROW_LIMIT,
) -> DataFrame:
    """Rows inserted within the last day although dated more than a week back."""
    now = resolve_as_of(df, inserted, as_of)
    if now is None:
        return df.withColumn("days_backdated", F.lit(0.0)).limit(0)
    old = ts_lit(now - dt.timedelta(days=BACKDATED_DAYS), df.schema[created].dataType)
    fresh = ts_lit(now - dt.timedelta(days=INSERT_DAYS), df.schema[inserted].dataType)
    at = ts_lit(now, df.schema[created].dataType)
    return (
        df.filter((F.col(created) < old) & (F.col(inserted) >= fresh))
        .withColumn("days_backdated", as_double(_days(at, F.col(created))))
        .orderBy(F.desc("days_backdated"), F.col(key))
        .limit(n)
    )


def future_summary(
    df: DataFrame, ts: str, as_of: dt.datetime | str, min_n: int = FUTURE_MIN_ROWS
) -> DataFrame:
    """Rows dated after ``as_of``; no row unless more than ``min_n``."""
    now = resolve_as_of(df, ts, as_of)
    at = ts_lit(now, df.schema[ts].dataType)
    ahead = F.sum((micros(ts) - micros(at)).cast("decimal(38,0)"))
    return (
        df.filter(F.col(ts) > at)
        .agg(
            F.count("*").alias("future_count"),
            ts_text(F.max(ts)).alias("furthest_future"),
            _mean_days(ahead, F.count("*"), DAY).alias("avg_days_ahead"),
        )
        .filter(F.col("future_count") > min_n)
    )


def future_rows(
    df: DataFrame, ts: str, as_of: dt.datetime | str, key: list[str], n: int = ROW_LIMIT
) -> DataFrame:
    """The rows dated furthest after ``as_of``."""
    at = ts_lit(resolve_as_of(df, ts, as_of), df.schema[ts].dataType)
    return df.filter(F.col(ts) > at).orderBy(F.col(ts).desc(), *key).limit(n)


def tamper_summary(df: DataFrame, created: str, updated: str) -> DataFrame:
    """Rows updated before they were created, and the mean gap in hours."""
    gap = F.sum((micros(created) - micros(updated)).cast("decimal(38,0)"))
    return (
        df.filter(F.col(updated) < F.col(created))
        .agg(
            F.count("*").alias("tampered_count"), _mean_days(gap, F.count("*"), HOUR).alias("avg_hours_diff")
        )
        .filter(F.col("tampered_count") > 0)
    )


def tamper_rows(df: DataFrame, created: str, updated: str, key: list[str], n: int = ROW_LIMIT) -> DataFrame:
    return df.filter(F.col(updated) < F.col(created)).orderBy(*key).limit(n)

