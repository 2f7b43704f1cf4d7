"""Profile states: what a profile is computed from, kept per file so that only changed files are read again.

A state holds, per column, counts, extremes, an exact sum and three mergeable
sketches (distinct values, ranks, frequent values). States of any parts of a table
add up to the state of the whole, so a profile after an ingest is the merge of the
stored states of the files that stayed and fresh states of those that are new. Figures without
"approx" in their name are exact and equal those of a fresh profile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.exprs import INTEGERS, NUMERIC, TEMPORAL, melt, micros, no_rows, ratio, sum_parts, total_parts, ts_text
from auditlake.operators.profile import _columns, type_family

#: log2 of the buckets of the distinct sketch (off by 2 % or so), and values the frequent-value sketch tracks.
DISTINCT_BITS, TRACKED = 12, 1000
#: Texts longer than this enter the frequent values by their beginning and a hash.
SHOWN = 64
PROFILE = (
    "column_name string, data_type string, total_count bigint, non_null_count bigint, null_count bigint, min_value string, "
    "max_value string, avg_value double, approx_distinct bigint, approx_median double, approx_p95 double, "
    "approx_median_time string, common_values array<struct<value:string,n:bigint>>"
)
_FILE = ("_file", "_modified", "_size", "_rows")


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def _time(kind: T.DataType) -> bool:
    return isinstance(kind, TEMPORAL)


def _item(c: Column, kind: T.DataType) -> Column:
    """A value as the frequent-value sketch tracks it: numbers as such, all else as text of bounded length."""
    if isinstance(kind, INTEGERS):
        return c.cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c
    text = c.cast("string")
    return F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN - 33), F.lit("~"), F.md5(text))).otherwise(text)


def _state(field: T.StructField, ranges: bool = True) -> Column:
    """The state of one column as an aggregate; extremes and sum are null without ``ranges``."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    text = c.cast("string")
    v = c if ranges else F.lit(None).cast(kind)
    if _number(kind):
        low, high, ranked = F.min(v), F.max(v), F.kll_sketch_agg_double(c.cast("double"))
    elif _time(kind):
        low, high, ranked = F.min(v), F.max(v), F.kll_sketch_agg_bigint(micros(c))
    else:  # texts have no extremes of interest; their lengths have ranks
        low, high, ranked = F.lit(None).cast("string"), F.lit(None).cast("string"), F.kll_sketch_agg_bigint(F.length(text).cast("bigint"))
    parts = [
        F.count(c).alias("n"), low.alias("low"), high.alias("high"), F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), DISTINCT_BITS).alias("seen"),
        ranked.alias("ranked"), F.call_function("approx_top_k_accumulate", _item(c, kind), F.lit(TRACKED)).alias("common"),
    ]
    if _number(kind):
        sums = [F.sum(part).alias(f"t{i}") for i, part in enumerate(sum_parts(v, kind))]
        parts.append(F.struct(*sums).alias("total"))
    return F.struct(*parts).alias(field.name)


def _merged(name: str, kind: T.DataType) -> Column:
    """States of one column of several parts as one."""
    at = lambda part: F.col(f"`{name}`.{part}")
    ranks = F.kll_merge_agg_double if _number(kind) else F.kll_merge_agg_bigint
    parts = [
        F.sum(at("n")).alias("n"), F.min(at("low")).alias("low"), F.max(at("high")).alias("high"), F.hll_union_agg(at("seen")).alias("seen"),
        ranks(at("ranked")).alias("ranked"), F.call_function("approx_top_k_combine", at("common"), F.lit(TRACKED)).alias("common"),
    ]
    if _number(kind):
        sums = [F.sum(at(f"total.t{i}")) for i in range(len(sum_parts(F.lit(0), kind)))]
        parts.append(total_parts(sums, kind).alias("total"))
    return F.struct(*parts).alias(name)


def _typed(df: DataFrame, cols: list[str] | None) -> tuple[DataFrame, list[T.StructField]]:
    df, cols = _columns(df, cols)
    return df, [df.schema[c] for c in cols]


def state_of(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None, ranges: bool = True) -> DataFrame:
    """One row of state per group of ``by``, or for the whole table: ``_rows`` and a struct per column."""
    df, fields = _typed(df, cols)
    aggs = [F.count("*").alias("_rows"), *(_state(f, ranges) for f in fields)]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def profile_of(states: DataFrame, fields: list[T.StructField], k: int = 5) -> DataFrame:
    """The profile of the whole from the states of its parts; one row per column (``PROFILE``), none without states.

    Ranks of texts are ranks of their lengths. Frequent values come with the count
    that the sketch found, largest first; it may be short by the rows over
    ``TRACKED`` for values that are not frequent.
    """
    if not fields:
        return no_rows(states, PROFILE.replace("array<struct<value:string,n:bigint>>", "string"))
    # One group by a constant: the sketches of frequent values cannot be merged in tasks without rows.
    whole = states.groupBy(F.lit(0).alias("_all")).agg(F.sum("_rows").alias("_rows"), *(_merged(f.name, f.dataType) for f in fields))
    rows = []
    none = lambda kind: F.lit(None).cast(kind)
    for f in fields:
        at = lambda part, f=f: F.col(f"`{f.name}`.{part}")
        n = F.coalesce(at("n"), F.lit(0).cast("bigint"))
        form = ts_text if _time(f.dataType) else lambda x: x.cast("string")
        read = F.kll_sketch_get_quantile_double if _number(f.dataType) else F.kll_sketch_get_quantile_bigint
        rank = lambda p, at=at, n=n, read=read: F.when(n > 0, read(at("ranked"), F.lit(p)))
        time = _time(f.dataType)
        common = F.call_function("approx_top_k_estimate", at("common"), F.lit(k + 1))
        known = F.slice(F.transform(F.filter(common, lambda x: x["item"].isNotNull()), lambda x: F.struct(x["item"].cast("string").alias("value"), x["count"].alias("n"))), 1, k)
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(type_family(f.dataType)).alias("data_type"),
                F.col("_rows").alias("total_count"),
                n.alias("non_null_count"),
                (F.col("_rows") - n).alias("null_count"),
                form(at("low")).alias("min_value"),
                form(at("high")).alias("max_value"),
                (ratio(at("total"), at("n")) if _number(f.dataType) else none("double")).alias("avg_value"),
                F.coalesce(F.hll_sketch_estimate(at("seen")), F.lit(0)).cast("bigint").alias("approx_distinct"),
                (none("double") if time else rank(0.5).cast("double")).alias("approx_median"),
                (none("double") if time else rank(0.95).cast("double")).alias("approx_p95"),
                (ts_text(F.timestamp_micros(rank(0.5))) if time else none("string")).alias("approx_median_time"),
                F.when(n > 0, known).alias("common_values"),
            )
        )
    return melt(whole, rows)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _modified, _size) of the parquet files below a path; no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return listed.select(_plain(F.col("path")).alias("_file"), F.col("modificationTime").alias("_modified"), F.col("length").alias("_size"))


def _plain(path: Column) -> Column:
    """One spelling of a path: a single slash behind the scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def refresh(spark: SparkSession, path: str, known: DataFrame | None = None, cols: list[str] | None = None) -> DataFrame:
    """States per file of the parquet table at ``path``: those of ``known`` where a file did not change, fresh ones else.

    Files are the same if name, time and size are. Only new and changed ones are
    read. ``known`` is an earlier result, kept as a table; files that are gone
    are not in the new one. Columns added to the table since make all files new.
    """
    table = spark.read.parquet(path)
    fields = _typed(table, cols)[1]
    now = files_of(spark, path)
    if known is not None and set(known.columns) != {*_FILE, *(f.name for f in fields)}:
        known = None
    same = ["_file", "_modified", "_size"]
    due = now if known is None else now.join(known.select(*same), same, "left_anti")
    # File names reach the driver, as in any listing.
    names = [r["_file"] for r in due.select("_file").collect()]
    kept = [] if known is None else [known.join(now.select(*same), same, "left_semi")]
    if not names:
        return kept[0] if kept else _nothing(table, fields)
    read = spark.read.schema(table.schema).option("basePath", path).parquet(*names)
    own = _plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("_file")
    fresh = state_of(read.select("*", own), [f.name for f in fields], ["_file"])
    fresh = due.join(fresh, "_file").select(*_FILE, *(f"`{f.name}`" for f in fields))
    return reduce(DataFrame.unionByName, [fresh, *(k.select(*fresh.columns) for k in kept)])


def _nothing(table: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """No states, in the columns that states have."""
    empty = table.filter("false").withColumns({"_file": F.lit(""), "_modified": F.current_timestamp(), "_size": F.lit(0).cast("bigint")})
    return state_of(empty, [f.name for f in fields], ["_file", "_modified", "_size"]).select(*_FILE, *(f"`{f.name}`" for f in fields))


def reprofile(spark: SparkSession, path: str, states: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The profile of the table at ``path`` from its states per file."""
    return profile_of(states, _typed(spark.read.parquet(path), cols)[1])


def approx_profile(df: DataFrame, cols: list[str] | None = None, k: int = 5, ranges: bool = True) -> DataFrame:
    """The profile of a wide or large table in one pass, columns of every kind, with no shuffle of values.

    Counts, extremes and means are exact; distinct values, ranks and frequent values
    come from sketches. Nested columns count as their JSON text. Without ``ranges``
    extremes and means are left out (null), which saves a third of the time.
    """
    return profile_of(state_of(df, cols, ranges=ranges), _typed(df, cols)[1], k)
