"""Read-only query shapes."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.exprs import (
    as_datetime, as_double, kind_of, mean_of, ratio, resolve_as_of, sum_parts, total_of, total_parts, trunc, ts_lit,
)
from auditlake.functions.ordering import row_numbers_split

RESULT_CAP = 1000  # fixed value: rows shown when a query names no limit


def select_where(df: DataFrame, cols: list[str], pred: Column, n: int, order_by: str) -> DataFrame:
    return df.filter(pred).select(*cols).orderBy(order_by).limit(n)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def top_k(df: DataFrame, measure: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), F.col(tie)).limit(k)


def group_count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(key))


def filtered_group_agg(df: DataFrame, pred: Column, key: str, measure: str) -> DataFrame:
    return (
        df.filter(pred)
        .groupBy(key)
        .agg(F.count("*").alias("n"), mean_of(measure, kind_of(df, measure)).alias("avg_value"))
    )


def monthly_sum(df: DataFrame, ts: str, measure: str, pred: Column) -> DataFrame:
    return (
        df.filter(pred)
        .groupBy(trunc("month", ts).alias("month"))
        .agg(total_of(measure, kind_of(df, measure)).alias("total"))
        .orderBy("month")
    )


def join_agg(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, group: str, measure: str
) -> DataFrame:
    """Inner join on a unique dimension key, then count, sum and mean per dimension group.

    The fact side is summed per join key before it meets the dimension: a hot
    key shrinks to one row per task, and only distinct keys are shuffled.
    """
    kind = kind_of(fact, measure)
    parts = [F.sum(part).alias(f"_s{i}") for i, part in enumerate(sum_parts(measure, kind))]
    per_key = fact.groupBy(F.col(fact_key).alias("_k")).agg(F.count("*").alias("_n"), F.count(measure).alias("_m"), *parts)
    joined = per_key.join(dim.select(F.col(dim_key).alias("_k"), group), "_k")
    total = total_parts([F.sum(f"_s{i}") for i in range(len(parts))], kind)
    return joined.groupBy(group).agg(
        F.sum("_n").alias("n"), total.alias("total"), as_double(ratio(total, F.sum("_m"))).alias("avg_value")
    )


def where_lt(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) < F.col(b))


def group_avg(df: DataFrame, key: str, measure: str) -> DataFrame:
    return df.groupBy(key).agg(mean_of(measure, kind_of(df, measure)).alias("avg_value"))


def semi_in(df: DataFrame, other: DataFrame, col: str, other_col: str) -> DataFrame:
    """Rows whose value occurs in the other table's column."""
    wanted = other.select(F.col(other_col).alias(col))
    return df.join(wanted, col, "left_semi")


def row_numbers(df: DataFrame, part: str, order: str, tie: str) -> DataFrame:
    """Row number per partition value, also where one value holds most rows."""
    return row_numbers_split(df, [part], [F.col(order), F.col(tie)])


def top_k_per_group(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, group: str, measure: str, k: int
) -> DataFrame:
    """The k dimension members with the largest summed measure, per group of the dimension."""
    per_key = fact.groupBy(F.col(fact_key).alias(dim_key)).agg(
        total_of(measure, kind_of(fact, measure)).alias("total")
    )
    joined = per_key.join(dim.select(dim_key, group), dim_key)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), F.col(dim_key)))
    return (
        joined.withColumn("place", place).filter(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))
    )


def kpis(orders: DataFrame, lines: DataFrame, price: str, discount: str, order_value: str) -> DataFrame:
    """Net revenue, mean order value and net share of gross over all lines and orders."""
    net = F.col(price) * (1 - F.col(discount))
    line_row = lines.agg(total_of(net).alias("total_revenue"), ratio(total_of(net), total_of(price)).alias("margin"))
    value = orders.agg(F.struct(mean_of(order_value).alias("v"), F.count("*").alias("n"))).scalar()
    return line_row.select(
        "total_revenue", value["v"].alias("avg_order_value"), value["n"].alias("order_count"), "margin"
    )


def scalar_agg(df: DataFrame, fn: str, col: str) -> DataFrame:
    """One figure of a column: sums and extremes in the column's own kind of number, the rest as doubles."""
    kind = kind_of(df, col)
    out = {
        "sum": total_of(col, kind),
        "avg": mean_of(col, kind),
        "min": F.min(col),
        "max": F.max(col),
        "count": F.count(col).cast("double"),
    }[fn]
    return df.agg(out.alias("value"))


def cohort_compare(df: DataFrame, flag: Column, measure: str) -> DataFrame:
    """Count, mean and sum of a measure for the rows inside and outside a cohort."""
    kind = kind_of(df, measure)
    return df.groupBy(F.coalesce(flag, F.lit(False)).alias("in_cohort")).agg(
        F.count("*").alias("n"), mean_of(measure, kind).alias("avg_value"), total_of(measure, kind).alias("total")
    )


def inactive_since(
    dim: DataFrame,
    log: DataFrame,
    dim_key: str,
    log_key: str,
    ts: str,
    days: int,
    as_of: dt.datetime | str | None = None,
) -> DataFrame:
    """Members of ``dim`` with no log row in the last ``days`` days."""
    now = resolve_as_of(log, ts, as_of)
    if now is None:
        return dim
    since = ts_lit(now - dt.timedelta(days=days), log.schema[ts].dataType)
    until = ts_lit(now, log.schema[ts].dataType)
    active = (
        log.filter((F.col(ts) >= since) & (F.col(ts) <= until))
        .select(F.col(log_key).alias(dim_key))
        .distinct()
    )
    return dim.join(active, dim_key, "left_anti")


def count_between(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """Rows with lo <= ts < hi."""
    kind = df.schema[ts].dataType
    inside = (F.col(ts) >= ts_lit(as_datetime(lo), kind)) & (F.col(ts) < ts_lit(as_datetime(hi), kind))
    return df.filter(inside).agg(F.count("*").alias("row_count"))


def search_sort_page(
    df: DataFrame, text: str, sort: str, asc: bool, page: int, size: int, key: str
) -> DataFrame:
    """Rows where any column holds the text, sorted with nulls last, one page of them."""
    needle = text.lower()
    hit = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in df.columns],
    )
    order = F.col(sort).asc_nulls_last() if asc else F.col(sort).desc_nulls_last()
    return df.filter(hit).orderBy(order, F.col(key)).offset((page - 1) * size).limit(size)


def capped(df: DataFrame, n: int = RESULT_CAP, order_by: list[str] | None = None) -> DataFrame:
    """Row queries without a limit of their own show ``n`` rows."""
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.limit(n)

