"""First-digit law and z-score outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.exprs import literal_table, as_double, ratio

# Expected first-digit percentages and the verdict limits.
BENFORD_PERCENT = {"1": 30.1, "2": 17.6, "3": 12.5, "4": 9.7, "5": 7.9, "6": 6.7, "7": 5.8, "8": 5.1, "9": 4.6}
BENFORD_MIN_DIGITS = 7
BENFORD_CRITICAL, BENFORD_HIGH = 15.51, 25.0
P_VALUE_STEPS = [(30.0, 0.001), (20.0, 0.01), (15.51, 0.05)]
P_VALUE_REST = 0.10
Z_LIMIT = 3.0
OUTLIER_MIN_ROWS, OUTLIER_MIN_PERCENT, OUTLIER_HIGH_PERCENT = 5, 1.0, 5.0
ROW_LIMIT = 100


def first_digit(amount: str) -> Column:
    """First digit of the value as written out: 0 below one, the leading digit from one on."""
    size = F.abs(F.col(amount))
    # From one on, a text with an exponent begins with the leading digit, too.
    return F.when(size < 1, "0").otherwise(F.substring(size.cast("string"), 1, 1))


def benford_distribution(df: DataFrame, amount: str) -> DataFrame:
    """First-digit counts of the positive amounts, with their share."""
    digits = (
        df.filter(F.col(amount) > 0)
        .groupBy(first_digit(amount).alias("digit"))
        .agg(F.count("*").alias("frequency"))
    )
    digits = digits.filter(F.col("digit").between("1", "9"))
    # Ten rows at most: the whole-table window runs after the aggregation.
    share = F.col("frequency") * F.lit(100.0) / F.sum("frequency").over(Window.partitionBy())
    return digits.withColumn("percentage", as_double(share))


def _p_value(chi: Column) -> Column:
    out = F.when(chi > P_VALUE_STEPS[0][0], P_VALUE_STEPS[0][1])
    for limit, p in P_VALUE_STEPS[1:]:
        out = out.when(chi > limit, p)
    return out.otherwise(P_VALUE_REST)


def benford_statistics(df: DataFrame, amount: str) -> DataFrame:
    """Chi-square of the first digits against the expected law, whether or not it is exceeded."""
    expected = literal_table(df.sparkSession, ["digit", "percent"], list(BENFORD_PERCENT.items()))
    seen = benford_distribution(df, amount).withColumn(
        "total", F.sum("frequency").over(Window.partitionBy())
    )
    e = F.col("percent") * F.col("total") / 100.0
    return seen.join(F.broadcast(expected), "digit").agg(
        F.count("*").alias("digits"),
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("rows_tested"),
        as_double(F.sum((F.col("frequency") - e) * (F.col("frequency") - e) / e)).alias("chi_square"),
    )


def benford_test(df: DataFrame, amount: str) -> DataFrame:
    """The verdict row; none unless seven digits occur and the critical value is exceeded."""
    chi = F.col("chi_square")
    return (
        benford_statistics(df, amount)
        .filter((F.col("digits") >= BENFORD_MIN_DIGITS) & (chi > BENFORD_CRITICAL))
        .withColumn("p_value", _p_value(chi))
        .withColumn("risk_level", F.when(chi < BENFORD_HIGH, "medium").otherwise("high"))
    )


def _spread(df: DataFrame, cols: list[str]) -> Column:
    """Mean, deviation and count of each column as one scalar subquery."""
    parts = []
    for i, c in enumerate(cols):
        parts += [
            F.avg(c).alias(f"m{i}"),
            F.nullif(F.stddev_samp(c), F.lit(0.0)).alias(f"s{i}"),
            F.count(c).alias(f"n{i}"),
        ]
    return df.agg(F.struct(*parts)).scalar()


def outlier_counts(cols: list[str], mean: list[Column], deviation: list[Column]) -> list[Column]:
    """Aggregates ``_z0``, ``_z1`` ...: outliers per column, given its mean and its deviation (null if there is none)."""
    aggs = []
    for i, c in enumerate(cols):
        z = F.abs(F.col(c) - mean[i]) / deviation[i]
        out = z > Z_LIMIT
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.when(out, 1)).alias("outlier_count"),
                as_double(F.max(F.when(out, z))).alias("max_z_score"),
                F.min(F.when(out, F.col(c))).cast("double").alias("min_value"),
                F.max(F.when(out, F.col(c))).cast("double").alias("max_value"),
                F.count(c).alias("total_count"),
            ).alias(f"_z{i}")
        )
    return aggs


def outlier_risk(outliers: Column, total: Column) -> Column:
    percent = F.coalesce(ratio(outliers * 100, total), F.lit(0.0))
    return (
        F.when((outliers <= OUTLIER_MIN_ROWS) | (percent <= OUTLIER_MIN_PERCENT), "none")
        .when(percent < OUTLIER_HIGH_PERCENT, "medium")
        .otherwise("high")
    )


def zscore_summary(df: DataFrame, cols: list[str], flagged_only: bool = True) -> DataFrame:
    """Outlier count, largest score, outlier range and share per column.

    Two scans for any number of columns: one for the moments, one for the outliers.
    """
    spread = _spread(df, cols)
    places = range(len(cols))
    aggs = outlier_counts(cols, [spread[f"m{i}"] for i in places], [spread[f"s{i}"] for i in places])
    rows = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_z{i}") for i in places])))
    percent = F.coalesce(ratio(F.col("outlier_count") * 100, F.col("total_count")), F.lit(0.0))
    judged = rows.withColumn("outlier_percent", as_double(percent)).withColumn(
        "risk_level", outlier_risk(F.col("outlier_count"), F.col("total_count"))
    )
    return judged.filter(F.col("risk_level") != "none") if flagged_only else judged


def zscore_rows(df: DataFrame, col: str, key: str, n: int = ROW_LIMIT) -> DataFrame:
    """The most extreme rows of a column."""
    spread = _spread(df, [col])
    z = as_double(F.abs(F.col(col) - spread["m0"]) / spread["s0"])
    return (
        df.withColumn("z_score", z)
        .filter(F.col("z_score") > Z_LIMIT)
        .orderBy(F.desc("z_score"), F.col(key))
        .limit(n)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
