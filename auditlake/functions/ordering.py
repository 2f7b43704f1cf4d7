"""Order-dependent results without one task per group.

A window over ``PARTITION BY key ORDER BY t`` puts a whole key into one task.
Here the rows are split by range over (key, order) first, so that a hot key is
spread over many ranges; each range is worked on by itself, and what it needs
from the ranges before it is a table of at most one row per range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import materialize, shuffle_width

RANGE = "_range"


def _split(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    width = shuffle_width(df.sparkSession)
    return df.repartitionByRange(width, *[F.col(k) for k in keys], *order).withColumn(
        RANGE, F.spark_partition_id()
    )


def _attach(parts: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join a table of at most one row per range to the rows of that range."""
    names = [*keys, RANGE]
    renamed = small.select(
        *[F.col(k).alias(f"_on_{k}") for k in names], *[c for c in small.columns if c not in names]
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in names])
    return parts.join(F.broadcast(renamed), match, "left")


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column | str],
    total_of: str | None = None,
) -> DataFrame:
    """Inclusive running sums per key in the given order.

    ``order`` must be unique within a key for a unique result. Adds one column
    for each entry of ``sums``, and ``_total``, the whole sum of the entry
    ``total_of`` for the key.
    """
    parts = _split(df, keys, order)
    group = Window.partitionBy(*keys, RANGE)
    inside = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    exprs = {n: F.col(v) if isinstance(v, str) else v for n, v in sums.items()}
    parts = parts.withColumns({n: F.sum(v).over(inside) for n, v in exprs.items()})
    parts = parts.withColumns({f"_part_{n}": F.sum(v).over(group) for n, v in exprs.items()})
    # The range bounds come from a sample: fix the outcome before reading it twice.
    parts = materialize(parts)

    per_range = parts.groupBy(*keys, RANGE).agg(*[F.max(f"_part_{n}").alias(f"_part_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    spread = per_range.select(
        *keys,
        RANGE,
        F.count("*").over(whole).alias("_ranges"),
        *[F.sum(f"_part_{n}").over(earlier).alias(f"_before_{n}") for n in sums],
        *([F.sum(f"_part_{total_of}").over(whole).alias("_all")] if total_of else []),
    ).filter(F.col("_ranges") > 1)
    # Only keys that reach over a range boundary are left, and a boundary cuts
    # one key: fewer than 2 * width rows.
    joined = _attach(parts, spread.drop("_ranges"), keys)
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.col(n) + F.col(f"_before_{n}"), F.col(n), F.col(f"_before_{n}")).alias(n)
            for n in sums
        ],
        *([F.coalesce("_all", f"_part_{total_of}").alias("_total")] if total_of else []),
    )


def row_numbers_split(df: DataFrame, keys: list[str], order: list[Column], name: str = "row_num") -> DataFrame:
    return prefix_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


def next_value(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """The value of the following row of the same key; null on the last row."""
    parts = _split(df, keys, order)
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order)
    parts = materialize(
        parts.withColumn("_next", F.lead(F.struct(value)).over(inside)).withColumn(
            "_first", F.row_number().over(inside) == 1
        )
    )
    firsts = parts.filter("_first").select(*keys, RANGE, F.struct(value).alias("_head"))
    across = Window.partitionBy(*keys).orderBy(RANGE)
    after = firsts.select(*keys, RANGE, F.lead("_head").over(across).alias("_head")).filter(
        F.col("_head").isNotNull()
    )
    # One row per range that another range of the same key follows: at most `width` rows.
    return _attach(parts, after, keys).select(
        *df.columns, F.coalesce("_next", "_head").getField(value).alias(name)
    )


# The sketch is off by at most 1 / ACCURACY of the ranks; the bracket is ten times wider.
ACCURACY, MARGIN = 10_000, 0.001


def bracket_sketch(value: Column, probs: dict[str, float]) -> Column:
    """Approximate values just below and just above each quantile."""
    ends = [e for p in probs.values() for e in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    return F.percentile_approx(value.cast("double"), ends, ACCURACY)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], stats: DataFrame | None = None
) -> DataFrame:
    """Exact interpolated quantiles per key, by one way for groups of every size.

    A sketch first brackets each quantile. Then only the values inside the
    brackets are ranked, a few thousandths of the rows, equal values counted as
    one, spread over ranges. No group is held by one task and no full sort is
    made. ``stats`` (keys, ``_size``, ``_ends``) may come from a pass the caller
    makes anyway.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if stats is None:
        stats = materialize(
            rows.groupBy(*keys).agg(
                F.count("*").alias("_size"), bracket_sketch(F.col("_v"), probs).alias("_ends")
            )
        )
    return _bracketed(_join_keys(rows, stats.filter("_size > 0"), keys, "inner"), keys, probs)


#: Groups whose brackets every task may hold.
MOST_GROUPS = 10_000


def _join_keys(rows: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on null-safe keys; the whole table when there are none.

    The brackets are a written table, whose size Spark does not know: few are
    counted and sent to the tasks, so the rows need not be shuffled by a few hot keys.
    """
    if keys and small.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS:
        small = F.broadcast(small)
    if not keys:
        one = small.select(F.struct("_size", "_ends").alias("s")).scalar()
        return rows.withColumn("_s", one).select("*", "_s._size", "_s._ends").drop("_s")
    right = small.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    joined = rows.join(right, match, how)
    return joined.drop(*[f"_on_{k}" for k in keys]) if how == "inner" else joined


BELOW, INSIDE, ABOVE = 0, 1, 2


def _bracketed(rows: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Rank the values inside each bracket.

    All values below a bracket are one row with their number and the largest of
    them, all above it one with the smallest: in a small group a quantile may lie
    between the bracket and its neighbour.
    """
    marks = []
    for i in range(len(probs)):
        low, high = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]
        side = F.when(F.col("_v") < low, BELOW).when(F.col("_v") > high, ABOVE).otherwise(INSIDE)
        marks.append(F.struct(F.lit(i).alias("_i"), side.alias("_side"), F.when(side == INSIDE, F.col("_v")).alias("_in")))
    counts = (
        rows.select(*keys, "_size", "_v", F.inline(F.array(*marks)))
        .groupBy(*keys, "_i", "_side", "_in")
        .agg(
            F.count("*").alias("_n"),
            F.when(F.col("_side") == ABOVE, F.min("_v")).otherwise(F.max("_v")).alias("_v"),
            F.max("_size").alias("_size"),
        )
    )
    ranked = prefix_sums(counts, [*keys, "_i"], [F.col("_side"), F.col("_v")], {"_cum": "_n"})
    # Of the values below only the last rank is known, of those above only the first.
    known = F.when(F.col("_side") == BELOW, F.col("_cum") - 1).otherwise(F.col("_cum") - F.col("_n"))
    last = F.when(F.col("_side") == ABOVE, known).otherwise(F.col("_cum") - 1)
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        spot = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        mine = F.col("_i") == i
        holds = lambda rank: mine & (known <= rank) & (rank <= last)
        a = F.max(F.when(holds(low), F.col("_v")))
        b = F.max(F.when(holds(high), F.col("_v")))
        exact = F.when(a == b, a).otherwise(a + (b - a) * F.max(spot - low))
        missed = (F.count(F.when(mine, 1)) > 0) & (a.isNull() | b.isNull())
        aggs.append(F.when(missed, F.raise_error(F.lit("quantile outside its bracket"))).otherwise(exact).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
