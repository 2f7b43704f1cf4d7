"""Number, time and label expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
RISK_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def as_col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x: str | Column) -> Column:
    """The value as a double. Results are rounded where they are shown, not here."""
    return as_col(x).cast("double")


def fixed_part(x: str | Column) -> Column:
    """What of a value twelve decimals hold; null for values of 1e15 and more, and those that are not finite."""
    value = as_col(x)
    return F.when(F.abs(value.cast("double")) < 1e15, value.try_cast("decimal(38,12)"))


def rest_part(x: str | Column) -> Column:
    """The value less its fixed part, as a double: nearly always zero."""
    return as_col(x).cast("double") - F.coalesce(fixed_part(x).cast("double"), F.lit(0.0))


LIMB, FINE = 26, 20
EXACT_BELOW = 1e15
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def sum_limbs(x: str | Column) -> list[Column]:
    """A double as four whole numbers of at most 26 bits, and the rest as a double that is nearly always zero.

    The whole part and twelve decimals, each in two limbs: sums of limbs are exact
    in any order for 2^37 rows, and cost no 38-digit arithmetic. Values that have
    four decimals at most are taken as printed. Of 1e15 and more, or not finite,
    all is rest.
    """
    v = as_col(x).cast("double")
    fits = F.abs(v) < EXACT_BELOW
    whole = F.when(fits, F.floor(v))
    four = F.rint(v * 10_000)
    fine = F.when(
        fits,
        F.when((four / 10_000 == v) & (F.abs(four) < 9e15), (four.cast("bigint") - whole * 10_000) * 100_000_000).otherwise(
            F.rint((v - whole) * 1e12).cast("bigint")
        ),
    )
    rest = F.when(fits, (v - whole) - fine / 1e12).otherwise(v)
    low = lambda n, bits: n.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return [F.shiftright(whole, LIMB), low(whole, LIMB), F.shiftright(fine, FINE), low(fine, FINE), rest]


def total_from(sums: list[Column]) -> Column:
    """The double that sums of limbs stand for; null if there were no values."""
    big = [s.cast("decimal(38,0)") for s in sums[:4]]
    whole = (big[0] * (1 << LIMB)).cast("decimal(38,0)") + big[1]
    fine = (big[2] * (1 << FINE)).cast("decimal(38,0)") + big[3]
    # Whole trillionths go over first, so both casts to a double are of exact numbers.
    over = F.floor(fine / F.lit(10**12).cast("decimal(38,0)"))
    left = fine - over.cast("decimal(38,0)") * F.lit(10**12).cast("decimal(38,0)")
    exact = (whole + over.cast("decimal(38,0)")).cast("decimal(26,0)").cast("decimal(38,12)") + left.cast("decimal(13,0)") * F.lit("0.000000000001").cast("decimal(12,12)")
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + sums[4]


def _integer_limbs(x: Column) -> list[Column]:
    c = x.cast("bigint")
    low = lambda n: n.bitwiseAND(F.lit((1 << 21) - 1).cast("bigint"))
    return [F.shiftright(c, 42), low(F.shiftright(c, 21)), low(c)]


def sum_parts(x: str | Column, kind: T.DataType | None = None) -> list[Column]:
    """What a value is cut into, so that plain sums of each part are exact; see ``total_of``."""
    if isinstance(kind, INTEGERS):
        return _integer_limbs(as_col(x))
    return [as_col(x)] if isinstance(kind, T.DecimalType) else sum_limbs(x)


def total_parts(sums: list[Column], kind: T.DataType | None = None) -> Column:
    """The sum of the values from the sums of their parts."""
    if isinstance(kind, INTEGERS):
        high, middle, low = (s.cast("decimal(38,0)") for s in sums)
        return ((high * (1 << 42)).cast("decimal(38,0)") + (middle * (1 << 21)).cast("decimal(38,0)") + low).cast("decimal(38,0)")
    return sums[0] if isinstance(kind, T.DecimalType) else total_from(sums)


def total_of(x: str | Column, kind: T.DataType | None = None) -> Column:
    """Sum of values of any size, in any order.

    By the type of the values: integers give an exact decimal(38,0), decimals a
    decimal of their own scale. All else, and values of no stated type, give a
    double, whose first twelve decimals add up exactly.
    """
    return total_parts([F.sum(part) for part in sum_parts(x, kind)], kind)


def kind_of(df: DataFrame, x: str | Column) -> T.DataType | None:
    """The type of a column; none for expressions."""
    return df.schema[x].dataType if isinstance(x, str) and x in df.columns else None


def mean_of(x: str | Column, kind: T.DataType | None = None) -> Column:
    """Sum over count of the values that are there, as a double; null without one."""
    return ratio(total_of(x, kind), F.count(as_col(x)))


def count_if(cond: Column) -> Column:
    """Rows for which the condition holds; 0 (not null) on no rows."""
    return F.count(F.when(cond, F.lit(1)))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when den is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970. Wall-clock times count without a time zone, so no clock change comes between two."""
    at = as_col(ts)
    since = (at.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
    wall = (since.cast("decimal(18,6)") * 1_000_000).cast("bigint")
    return F.when(F.typeof(at) == "timestamp", F.unix_micros(at.cast("timestamp"))).otherwise(wall)


def number_text(x: str | Column, kind: T.DataType | None = None) -> Column:
    """A number as text. Doubles are plain from 1e-4 to below 1e16, where Spark's cast leaves 1e-3 to 1e7; others as 1e+16, 9.9e-05."""
    text = as_col(x).cast("string")
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return text
    size, at = F.abs(as_col(x)), lambda limit: F.lit(limit).cast(kind)
    # At most 17 digits, so 22 decimals hold them all.
    plain = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.0)?E([0-9])", "e+$2"), r"(\.0)?E-", "e-")
    return (
        F.when(~text.contains("E"), text)
        .when((size >= at(1e-4)) & (size < at(1e16)), plain)
        .otherwise(F.regexp_replace(short, "e-([0-9])$", "e-0$1"))
    )


def ts_text(ts: str | Column) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_text(ts: str | Column) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd")


def trunc(grain: str, ts: str | Column) -> Column:
    return F.date_trunc(grain, as_col(ts)).cast("timestamp_ntz")


def ts_lit(value: dt.datetime | str, like: T.DataType | None = None) -> Column:
    """A literal of the column's own timestamp type, so the filter reaches the scan."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    name = "timestamp" if isinstance(like, T.TimestampType) else "timestamp_ntz"
    return F.lit(text).cast(name)


def as_datetime(value: dt.datetime | dt.date | str) -> dt.datetime:
    if isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime):
        return value
    return dt.datetime(value.year, value.month, value.day)


def resolve_as_of(df: DataFrame, ts: str, as_of: dt.datetime | str | None) -> dt.datetime | None:
    """The reference time of a time-bounded operator; the last time in the data by default.

    It is one scalar, fetched so that range predicates become literals the
    parquet reader can prune row groups with.
    """
    if as_of is not None:
        return as_datetime(as_of)
    last = df.agg(F.max(ts).alias("m")).first()["m"]
    return None if last is None else as_datetime(last)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower limit the value reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for limit, label in steps[1:]:
        out = out.when(value >= limit, label)
    return out.otherwise(otherwise)


def risk_rank(level: str | Column) -> Column:
    """Order of a risk level; unknown levels rank lowest."""
    out = F.lit(0)
    for name, rank in RISK_RANK.items():
        out = F.when(as_col(level) == name, rank).otherwise(out)
    return out


def literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of constants the caller passed in, without a Python worker."""
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


def melt(row: DataFrame, entries: list[Column]) -> DataFrame:
    """Turn one aggregate row into one row per entry (a struct column each)."""
    return row.select(F.inline(F.array(*entries)))


def flattened(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so that they can be counted, compared and hashed. Nulls stay."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def no_rows(df: DataFrame, schema: str) -> DataFrame:
    """An empty frame of the given columns, for operators that find nothing to work on."""
    names = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    return df.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in names])
