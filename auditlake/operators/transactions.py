"""Transaction patterns: duplicates, round amounts, velocity, structuring, odd hours."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.exprs import (
    count_if, day_text, kind_of, total_of, micros, as_double, ratio, resolve_as_of, ts_lit,
)
from auditlake.functions.ordering import prefix_sums

# Thresholds of the detectors.
ROUND_FLAG_PERCENT, ROUND_HIGH_PERCENT = 20.0, 40.0
ROUND_MIN_FREQUENCY = 10
VELOCITY_MIN_ROWS = 10
STRUCTURING_BANDS = [(9000, 9999), (4900, 4999)]
STRUCTURING_MIN_ROWS = 3
NIGHT_HOURS = [(0, 5), (22, 23)]
ROW_LIMIT = 100


def trailing(df: DataFrame, ts: str, window: dt.timedelta, as_of: dt.datetime | str | None) -> DataFrame:
    """Rows of the window that ends at ``as_of``; a literal range, so the scan can skip files."""
    now = resolve_as_of(df, ts, as_of)
    if now is None:
        return df.limit(0)
    kind = df.schema[ts].dataType
    return df.filter((F.col(ts) >= ts_lit(now - window, kind)) & (F.col(ts) <= ts_lit(now, kind)))


def duplicates(
    df: DataFrame,
    keys: list[str],
    ts: str | None = None,
    window: dt.timedelta | None = None,
    as_of: dt.datetime | str | None = None,
) -> DataFrame:
    """Key groups that occur more than once, optionally only in a trailing window."""
    rows = trailing(df, ts, window, as_of) if window is not None else df
    return rows.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)


def round_ratio(df: DataFrame, amount: str, small: int = 100, big: int = 1000) -> DataFrame:
    """Share of amounts divisible by ``small`` (and ``big``), with the verdict."""
    value = F.col(amount)
    row = df.filter(F.col(amount).isNotNull()).agg(
        F.count("*").alias("total"),
        count_if(value % small == 0).alias("round_small"),
        count_if(value % big == 0).alias("round_big"),
    )
    share = F.coalesce(ratio(F.col("round_small") * 100, F.col("total")), F.lit(0.0))
    return row.withColumn("round_percent", as_double(share)).withColumn(
        "risk_level",
        F.when(share <= ROUND_FLAG_PERCENT, "none")
        .when(share < ROUND_HIGH_PERCENT, "medium")
        .otherwise("high"),
    )


def round_amounts(
    df: DataFrame, amount: str, min_freq: int = ROUND_MIN_FREQUENCY, modulus: int = 100
) -> DataFrame:
    """Round amounts that come up more than ``min_freq`` times."""
    value = F.col(amount)
    return (
        df.filter(value % modulus == 0)
        .groupBy(amount)
        .agg(F.count("*").alias("frequency"))
        .filter(F.col("frequency") > min_freq)
    )


def fast_users(
    df: DataFrame,
    user: str,
    ts: str,
    window: dt.timedelta = dt.timedelta(hours=1),
    min_n: int = VELOCITY_MIN_ROWS,
    as_of: dt.datetime | str | None = None,
) -> DataFrame:
    """Users with more than ``min_n`` rows in the last window, all within less than its length."""
    recent = trailing(df, ts, window, as_of)
    span = (F.max(micros(ts)) - F.min(micros(ts))) / 60e6
    return (
        recent.groupBy(user)
        .agg(F.count("*").alias("tx_count"), as_double(span).alias("span_minutes"))
        .filter((F.col("tx_count") > min_n) & (F.col("span_minutes") < window.total_seconds() / 60))
    )


def velocity(
    df: DataFrame,
    user: str,
    ts: str,
    window: dt.timedelta = dt.timedelta(hours=1),
    min_n: int = VELOCITY_MIN_ROWS,
    as_of: dt.datetime | str | None = None,
    top: int = 5,
) -> DataFrame:
    """The ``top`` users by rows in the last window."""
    users = fast_users(df, user, ts, window, min_n, as_of)
    return users.orderBy(F.desc("tx_count"), F.col(user)).limit(top)


def velocity_all(
    df: DataFrame,
    user: str,
    ts: str,
    window: dt.timedelta = dt.timedelta(hours=1),
    min_n: int = VELOCITY_MIN_ROWS,
) -> DataFrame:
    """Per user: the busiest trailing window at any time, and how many instants exceed ``min_n``.

    Rows up to an instant less those up to its window's begin: each instant looks
    up both in one running sum, for which it stands in the order of times twice.
    The running sum is split by ranges of (user, time), so a user's busiest hour is
    as many tasks as its rows ask for.
    """
    size = int(window.total_seconds() * 1_000_000)
    instants = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(F.col(user), micros(ts).alias("_t"))
        .agg(F.count("*").alias("_n"))
    )
    # Rows at the very begin of a window belong to it: its mark goes before them.
    marks = instants.select(user, "_t", F.lit(0).cast("bigint").alias("_n"), (F.col("_t") - size).alias("_at"), F.lit(0).alias("_kind"))
    both = instants.select(user, "_t", "_n", F.col("_t").alias("_at"), F.lit(1).alias("_kind")).unionByName(marks)
    summed = prefix_sums(both, [user], [F.col("_at"), F.col("_kind"), F.col("_t")], {"_upto": "_n"})
    upto = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_upto")))
    counted = summed.groupBy(user, "_t").agg((upto(1) - upto(0)).alias("_in_window")).filter(F.col("_in_window") > min_n)
    return counted.groupBy(user).agg(
        F.max("_in_window").alias("peak_count"), F.count("*").alias("instants_over")
    )


def structuring(
    df: DataFrame,
    user: str,
    ts: str,
    amount: str,
    bands: list[tuple[float, float]] = STRUCTURING_BANDS,
    min_n: int = STRUCTURING_MIN_ROWS,
) -> DataFrame:
    """Users with several amounts just below a reporting limit on one day."""
    in_band = reduce(lambda a, b: a | b, [F.col(amount).between(lo, hi) for lo, hi in bands])
    return (
        df.filter(in_band)
        .groupBy(user, day_text(ts).alias("day"))
        .agg(F.count("*").alias("tx_count"), total_of(amount, kind_of(df, amount)).alias("total_amount"))
        .filter(F.col("tx_count") >= min_n)
    )


def in_night(ts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.hour(ts).between(lo, hi) for lo, hi in NIGHT_HOURS])


def off_hours(df: DataFrame, ts: str, key: str, n: int = ROW_LIMIT) -> DataFrame:
    """The newest rows made at night."""
    return df.filter(in_night(ts)).orderBy(F.col(ts).desc(), F.col(key)).limit(n)
