"""Column profiles. One pass over the table serves all columns."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.exprs import (
    FRACTIONAL, NUMERIC, TEMPORAL, kind_of, literal_table, melt, numeric_columns, as_double, ratio,
    string_columns,
    temporal_columns, trunc, ts_text, mean_of, number_text, total_of, flattened, no_rows,
)
from auditlake.functions.ordering import bracket_sketch, exact_quantiles
from auditlake.session import materialize


def _columns(df: DataFrame, cols: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The table with nested values as text, and the columns asked for, all by default."""
    return flattened(df), cols if cols is not None else df.columns


def long_form(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """(column_name, value) rows of the named columns."""
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("value")) for c in cols]
    return df.select(F.inline(F.array(*entries)))


def type_family(dtype: T.DataType) -> str:
    """text, integer, numeric, boolean, temporal or other."""
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, FRACTIONAL):
        return "numeric"
    if isinstance(dtype, NUMERIC):
        return "integer"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, TEMPORAL):
        return "temporal"
    return "other"


#: Characters of a text that a value is grouped by; longer ones go on by their SHA-256.
HEAD = 64


def _form(dtype: T.DataType) -> str:
    """The type that values of a column are grouped in; columns of one form share an aggregate."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    return dtype.simpleString() if isinstance(dtype, (T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def _grouped(df: DataFrame, cols: list[str], texts: bool = False) -> list[DataFrame]:
    """The distinct values of all columns with their number, per form: (_c: the column's place, _v, _x, _n).

    Values are counted per task first, so only distinct ones are shuffled and a hot
    value weighs nothing. A long text is its beginning ``_v`` and its digest ``_x``.
    -0.0 and 0.0 are one value; with ``texts`` they are two, told apart by their text ``_x``.
    """
    forms: dict[str, list[int]] = {}
    for i, c in enumerate(cols):
        forms.setdefault(_form(df.schema[c].dataType), []).append(i)
    out = []
    for form, places in forms.items():
        zeros = texts and form in ("float", "double")
        entries = []
        for i in places:
            v = F.col(f"`{cols[i]}`").cast(form)
            parts = [F.lit(i).alias("_c"), (F.substring(v, 1, HEAD) if form == "string" else v).alias("_v")]
            if form == "string":
                parts.append(F.when(F.length(v) > HEAD, F.sha2(v, 256)).alias("_x"))
            elif zeros:
                parts.append(F.when(v == 0, v.cast("string")).alias("_x"))
            entries.append(F.struct(*parts))
        keys = ["_c", "_v", "_x"] if form == "string" or zeros else ["_c", "_v"]
        out.append(df.select(F.inline(F.array(*entries))).groupBy(*keys).agg(F.count("*").alias("_n")))
    return out


def column_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Total, distinct, non-null and null count per column; each column is read once."""
    df, cols = _columns(df, cols)
    there = F.col("_v").isNotNull()
    parts = [
        values.groupBy("_c").agg(
            F.sum("_n").alias("total_count"),
            F.count("_v").alias("distinct_count"),
            F.sum(F.when(there, F.col("_n")).otherwise(0)).alias("non_null_count"),
        )
        for values in _grouped(df, cols)
    ]
    found = reduce(DataFrame.unionByName, parts)
    # An empty table still has its columns.
    known = literal_table(df.sparkSession, ["_c", "column_name"], list(enumerate(cols)))
    figure = lambda name: F.coalesce(name, F.lit(0).cast("bigint"))
    return known.join(found, "_c", "left").select(
        "column_name",
        *[figure(n).alias(n) for n in ("total_count", "distinct_count", "non_null_count")],
        (figure("total_count") - figure("non_null_count")).alias("null_count"),
    )


def numeric_range(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Min, max and mean per numeric column; the extremes as doubles, and exact as text."""
    cols = cols or numeric_columns(df)
    if not cols:
        return no_rows(df, "column_name string, min_value double, max_value double, avg_value double, min_exact string, max_exact string")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"_a{i}"), F.max(c).alias(f"_b{i}"), mean_of(c, kind_of(df, c)).alias(f"_m{i}")]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_a{i}").cast("double").alias("min_value"),
            F.col(f"_b{i}").cast("double").alias("max_value"),
            F.col(f"_m{i}").alias("avg_value"),
            number_text(f"_a{i}", kind_of(df, c)).alias("min_exact"),
            number_text(f"_b{i}", kind_of(df, c)).alias("max_exact"),
        )
        for i, c in enumerate(cols)
    ]
    return melt(df.agg(*aggs), entries)


def temporal_range(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """First and last time per temporal column, as text."""
    cols = cols or temporal_columns(df)
    if not cols:
        return no_rows(df, "column_name string, min_value string, max_value string")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"_a{i}"), F.max(c).alias(f"_b{i}")]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            ts_text(f"_a{i}").alias("min_value"),
            ts_text(f"_b{i}").alias("max_value"),
        )
        for i, c in enumerate(cols)
    ]
    return melt(df.agg(*aggs), entries)


def distinct_samples(df: DataFrame, n: int = 5, cols: list[str] | None = None) -> DataFrame:
    """The n smallest distinct values per column, as text, in order.

    The distinct values that ``column_counts`` makes are enough, but for long texts:
    these are looked up once more among the rows that begin no later than the n
    smallest beginnings. A task passes on n values per column.
    """
    df, cols = _columns(df, cols)
    place = F.row_number().over(Window.partitionBy("_c").orderBy("value"))
    least = lambda values: values.withColumn("_p", place).filter(F.col("_p") <= n)
    shown = lambda g: number_text("_v", g.schema["_v"].dataType)
    text = lambda g: F.coalesce("_x", shown(g)) if dict(g.dtypes)["_v"] in ("float", "double") else shown(g)
    parts = [g.filter("_v IS NOT NULL").select("_c", text(g).alias("value")) for g in _grouped(df, cols, texts=True)]
    heads = least(reduce(DataFrame.unionByName, parts).distinct())
    texts = [i for i, c in enumerate(cols) if _form(df.schema[c].dataType) == "string"]
    found = heads.filter(~F.col("_c").isin(texts)).select("_c", "value") if texts else heads.select("_c", "value")
    if texts:
        # One row per column.
        last = F.broadcast(heads.filter(F.col("_c").isin(texts)).groupBy("_c").agg(F.max("value").alias("_last")))
        entries = [F.struct(F.lit(i).alias("_c"), F.col(f"`{cols[i]}`").cast("string").alias("value")) for i in texts]
        near = df.select(F.inline(F.array(*entries))).join(last, "_c").filter(F.substring("value", 1, HEAD) <= F.col("_last"))
        found = found.unionByName(least(near.select("_c", "value").distinct()).select("_c", "value"))
    known = literal_table(df.sparkSession, ["_c", "column_name"], list(enumerate(cols)))
    listed = found.groupBy("_c").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    return known.join(listed, "_c").select("column_name", "sample_values")


def column_profile(df: DataFrame, n: int = 5, cols: list[str] | None = None) -> DataFrame:
    """Counts, ranges and samples together, one row per column."""
    df, cols = _columns(df, cols)
    aggs = [F.lit(1).alias("_one")]
    entries = []
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        low = high = F.lit(None).cast("string")
        avg = F.lit(None).cast("double")
        if isinstance(kind, (*NUMERIC, *TEMPORAL)):
            aggs += [F.min(c).alias(f"_a{i}"), F.max(c).alias(f"_b{i}")]
            text = ts_text if isinstance(kind, TEMPORAL) else lambda x: number_text(x, kind)
            low, high = text(f"_a{i}"), text(f"_b{i}")
        if isinstance(kind, NUMERIC):
            aggs.append(mean_of(c, kind).alias(f"_m{i}"))
            avg = F.col(f"_m{i}")
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(type_family(kind)).alias("data_type"),
                low.alias("min_value"),
                high.alias("max_value"),
                avg.alias("avg_value"),
            )
        )
    ranges = melt(df.agg(*aggs), entries)
    counts = column_counts(df, cols).drop("non_null_count")
    return counts.join(ranges, "column_name").join(distinct_samples(df, n, cols), "column_name", "left").select(
        "column_name", "data_type", "total_count", "distinct_count", "null_count", "min_value", "max_value",
        "avg_value", "sample_values",
    )


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Min, max, mean, median, sample deviation and nulls per numeric column."""
    cols = cols or numeric_columns(df)
    if not cols:
        names = ("min_value", "max_value", "mean", "std_dev")
        return no_rows(df, "column_name string, " + ", ".join(f"{n} double" for n in names) + ", null_count bigint, median double")
    probs = {"median": 0.5}
    aggs = [F.count("*").alias("_total")]
    for i, c in enumerate(cols):
        aggs += [
            F.count(c).alias(f"_nn{i}"),
            F.min(c).cast("double").alias(f"_a{i}"),
            F.max(c).cast("double").alias(f"_b{i}"),
            mean_of(c, kind_of(df, c)).alias(f"_m{i}"),
            as_double(F.stddev_samp(c)).alias(f"_s{i}"),
            bracket_sketch(F.col(c), probs).alias(f"_k{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_a{i}").alias("min_value"),
            F.col(f"_b{i}").alias("max_value"),
            F.col(f"_m{i}").alias("mean"),
            F.col(f"_s{i}").alias("std_dev"),
            (F.col("_total") - F.col(f"_nn{i}")).alias("null_count"),
            F.col(f"_nn{i}").alias("_size"),
            F.col(f"_k{i}").alias("_ends"),
        )
        for i, c in enumerate(cols)
    ]
    # One row per column, with the brackets the medians are looked for in.
    figures = materialize(melt(df.agg(*aggs), entries))
    stats = figures.filter("_size > 0").select("column_name", "_size", "_ends")
    medians = exact_quantiles(long_form(df, cols, "double"), ["column_name"], "value", probs, stats)
    return figures.drop("_size", "_ends").join(medians, "column_name", "left")


def categorical_summary(df: DataFrame, k: int = 5, cols: list[str] | None = None) -> DataFrame:
    """The k most frequent values per column with their counts, unique values and nulls."""
    cols = cols or string_columns(df)
    if not cols:
        return no_rows(df, "column_name string, unique_values bigint, null_count bigint, place bigint, value string, n bigint")
    counts = long_form(df, cols, "string").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    shape = counts.groupBy("column_name").agg(
        F.count("value").alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    )
    # Nulls rank last instead of being filtered early, so both uses share one shuffle.
    order = [F.col("value").isNull(), F.desc("n"), F.col("value")]
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(*order))
    top = (
        counts.withColumn("place", place)
        .filter((F.col("place") <= k) & F.col("value").isNotNull())
        .withColumn("place", F.col("place").cast("bigint"))
    )
    return shape.join(top, "column_name", "left").select(
        "column_name", "unique_values", "null_count", "place", "value", "n"
    )


def missing_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column; no distinct counting, so no shuffle of values."""
    df, cols = _columns(df, cols)
    row = df.agg(F.count("*").alias("_total"), *[F.count(c).alias(f"_nn{i}") for i, c in enumerate(cols)])
    return melt(
        row,
        [
            F.struct(
                F.lit(c).alias("column_name"), (F.col("_total") - F.col(f"_nn{i}")).alias("missing")
            )
            for i, c in enumerate(cols)
        ],
    )


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of each column pair, all in one pass."""
    pairs = list(itertools.combinations(cols, 2))
    row = df.agg(*[as_double(F.corr(a, b)).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    return melt(
        row,
        [
            F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"_r{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ],
    )


def column_ratios(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Share of non-null rows, and distinct values per non-null row."""
    return column_counts(df, cols).select(
        "column_name",
        as_double(ratio(F.col("non_null_count"), F.col("total_count"))).alias("completeness"),
        as_double(ratio(F.col("distinct_count"), F.col("non_null_count"))).alias("cardinality_ratio"),
    )


STABLE_R2 = 0.1


def trend(df: DataFrame, ts: str, measure: str, grain: str = "month") -> DataFrame:
    """Least-squares line through the bucket sums; strength is its r squared."""
    buckets = df.groupBy(trunc(grain, ts).alias("bucket")).agg(as_double(total_of(measure, kind_of(df, measure))).alias("total"))
    # One row per bucket of time: the number of buckets is bounded by the calendar.
    numbered = buckets.withColumn("x", (F.row_number().over(Window.orderBy("bucket")) - 1).cast("double"))
    line = numbered.agg(
        F.count("*").alias("buckets"),
        as_double(F.regr_slope("total", "x")).alias("slope"),
        as_double(F.coalesce(F.regr_r2("total", "x"), F.lit(0.0))).alias("strength"),
    )
    return line.withColumn(
        "direction",
        F.when((F.col("strength") < STABLE_R2) | F.col("slope").isNull(), "stable")
        .when(F.col("slope") > 0, "increasing")
        .otherwise("decreasing"),
    )
