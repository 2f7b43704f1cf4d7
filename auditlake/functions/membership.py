"""Which columns hold which values, for many columns of many tables at once.

Every table is read once. Its values of interest go into one shuffle by value; there each distinct value carries the set of columns that hold it, and any
question of the kind "which values of this column are in that one" is a sum over
these sets. Rows are combined per task first, so a hot value weighs nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.exprs import INTEGERS

#: Columns in one word of a set.
WORD = 62


def comparable(field: T.StructField) -> Column:
    """A value as text, so that equal values of different types read alike.

    Whole numbers read as integers whatever their type, other numbers as doubles,
    dates as the times they begin at. Long texts read as their SHA-256.
    """
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("double").cast("string"))
    if isinstance(kind, T.DecimalType):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("double").cast("string"))
    if isinstance(kind, T.DateType):
        return c.cast("timestamp_ntz").cast("string")
    text = c.cast("string")
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text) if isinstance(kind, T.StringType) else text


def memberships(tables: dict[str, DataFrame], columns: list[tuple[str, str]], counted: set[int] = frozenset()) -> DataFrame:
    """One row per distinct value of any of the (table, column) pairs.

    ``_s0``, ``_s1`` ...: the set of columns that hold it, as bits by their place in
    ``columns`` (see ``holds``). ``_n<i>``: rows with it in column i, for the places
    in ``counted``. Nulls are no values.
    """
    fields = [tables[t].schema[c] for t, c in columns]
    # Keys are mostly integers, which need not become text to be compared.
    whole = all(isinstance(f.dataType, INTEGERS) for f in fields)
    read = lambda f: F.col(f"`{f.name}`").cast("bigint") if whole else comparable(f)
    parts = []
    for name in dict.fromkeys(t for t, _ in columns):
        df = tables[name]
        entries = [F.struct(F.lit(i).alias("_c"), read(fields[i]).alias("_v")) for i, (t, _) in enumerate(columns) if t == name]
        parts.append(df.select(F.inline(F.array(*entries))).filter("_v IS NOT NULL"))
    at = F.col("_c")
    words = range(-(-len(columns) // WORD))
    bit = lambda w: F.when((at >= w * WORD) & (at < (w + 1) * WORD), F.call_function("shiftleft", F.lit(1).cast("bigint"), at - w * WORD))
    return reduce(DataFrame.unionByName, parts).groupBy("_v").agg(
        *[F.coalesce(F.bit_or(bit(w)), F.lit(0).cast("bigint")).alias(f"_s{w}") for w in words],
        *[F.sum(F.when(at == i, 1).otherwise(0)).alias(f"_n{i}") for i in sorted(counted)],
    )


def holds(i: int) -> Column:
    """Whether column ``i`` holds the value of a row of ``memberships``."""
    return F.col(f"_s{i // WORD}").bitwiseAND(F.lit(1 << i % WORD).cast("bigint")) != 0
