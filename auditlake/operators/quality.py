"""Data quality: scores, inferred types, value patterns and stability classes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.exprs import count_if, ladder, literal_table, as_double, ratio, resolve_as_of, ts_lit
from auditlake.operators.profile import _columns, long_form

# The value checks, in the order ties are decided.
TYPE_PATTERNS = {
    "integer": r"^[0-9]+$",
    "float": r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "boolean": r"^(?i:true|false|t|f|1|0|yes|no|y|n)$",
    "date": r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": None,
    "url": r"^(?i:https?://[^\s/$.?#].[^\s]*)$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
PHONE_SEPARATORS = r"[\s\-\(\)\+\.]"
PHONE_MIN_LENGTH = 10
PHONE_DIGIT_SHARE = 0.7
TYPE_MIN_SHARE = 0.7
# Class limits.
CARDINALITY_STEPS = [(0.95, "unique"), (0.5, "high"), (0.1, "medium")]
NULL_STEPS = [(0.95, "complete"), (0.8, "mostly_complete"), (0.5, "partial")]
FRESH_DAYS, MODERATE_DAYS = 7, 30
LONG_TEXT, SHORT_CODE = 50, 10


def matches_type(text: Column, kind: str) -> Column:
    if kind == "phone":
        bare = F.regexp_replace(text, PHONE_SEPARATORS, "")
        digits = F.regexp_replace(bare, "[^0-9]", "")
        return (F.length(bare) >= PHONE_MIN_LENGTH) & (
            F.length(digits) / F.length(bare) > PHONE_DIGIT_SHARE
        )
    return text.rlike(TYPE_PATTERNS[kind])


def _completeness(cols: list[str]) -> Column:
    filled = [
        F.sum(F.col(c).cast("string").rlike(r"\S").cast("bigint")).cast("double") for c in cols
    ]
    total = F.coalesce(filled[0], F.lit(0.0))
    for f in filled[1:]:
        total = total + F.coalesce(f, F.lit(0.0))
    return F.coalesce(ratio(total, F.count("*") * len(cols)), F.lit(0.0))


def _consistency(cols: list[str]) -> Column:
    scores = [
        F.when(
            F.count(c) > 0,
            1.0 / (1.0 + F.coalesce(F.var_samp(F.length(F.col(c).cast("string"))), F.lit(0.0)) / 10.0),
        )
        for c in cols
    ]
    present = sum((F.when(s.isNotNull(), 1.0).otherwise(0.0) for s in scores), F.lit(0.0))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0))
    return F.coalesce(ratio(total, present), F.lit(0.0))


def quality_score(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Completeness, consistency of value lengths, and their mean."""
    df, cols = _columns(df, cols)
    row = df.agg(_completeness(cols).alias("c"), _consistency(cols).alias("s"))
    return row.select(
        as_double("c").alias("completeness"), as_double("s").alias("consistency"), as_double((F.col("c") + F.col("s")) / 2).alias("overall")
    )


def semantic_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The type most values of a column look like, over the whole column."""
    df, cols = _columns(df, cols)
    kinds = list(TYPE_PATTERNS)
    # Long form: one small set of checks for all columns, combined per task before the shuffle.
    hits = (
        long_form(df, cols, "string")
        .groupBy("column_name")
        .agg(F.count("value").alias("_n"), *[count_if(matches_type(F.col("value"), k)).alias(k) for k in kinds])
    )
    shares = hits.select(
        "column_name", *[F.coalesce(ratio(F.col(k), F.col("_n")), F.lit(0.0)).alias(k) for k in kinds]
    ).withColumn("_best", F.greatest(*kinds))
    name = F.when(F.col(kinds[0]) == F.col("_best"), kinds[0])
    for k in kinds[1:]:
        name = name.when(F.col(k) == F.col("_best"), k)
    return shares.select(
        "column_name",
        F.when(F.col("_best") > TYPE_MIN_SHARE, name).otherwise("string").alias("semantic_type"),
        as_double("_best").alias("confidence"),
    )


def value_patterns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Shape shared by all values of a column; the first that holds."""
    df, cols = _columns(df, cols)
    v, size = F.col("value"), F.length("value")
    # The first two characters as one number: text minima would make Spark sort every row.
    code = lambda i: F.ascii(F.substring(v, i, 1)).cast("bigint")
    head = F.when(size >= 2, code(1) * (1 << 21) + code(2))
    found = (
        long_form(df, cols, "string")
        .groupBy("column_name")
        .agg(
            F.count(v).alias("_n"),
            (F.min(size) == F.max(size)).alias("_len"),
            F.bool_and(F.when(size > 0, v.rlike("[0-9]$"))).alias("_suf"),
            (F.min(head) == F.max(head)).alias("_pre"),
            F.bool_and(v.rlike(r"[-_.]")).alias("_sep"),
        )
    )
    return found.select(
        "column_name",
        F.when(F.col("_n") == 0, "none")
        .when(F.col("_len"), "constant_length")
        .when(F.coalesce("_suf", F.lit(True)), "numeric_suffix")
        .when(F.col("_pre"), "prefix_pattern")
        .when(F.col("_sep"), "contains_separators")
        .otherwise("variable")
        .alias("pattern"),
    )


def column_classes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """All classes of each column and the row count, in one pass over the table.

    The columns are worked on in long form, so one small set of aggregates
    serves a table of any width; each task combines its values first.
    """
    df, cols = _columns(df, cols)
    v, size = F.col("value"), F.length("value")
    text = F.when(size > 0, v)
    found = (
        long_form(df, cols, "string")
        .groupBy("column_name")
        .agg(
            F.count("*").alias("_total"),
            F.count(v).alias("_n"),
            # Long texts count by their hash: the shuffled key stays short.
            F.countDistinct(F.when(size > 64, F.sha2(v, 256)).otherwise(v)).alias("_d"),
            (F.max(size) - F.min(size)).alias("_w"),
            F.count(text).alias("_t"),
            F.bool_and(text.rlike("^[0-9]+$")).alias("_id"),
            F.bool_and(text.contains("@")).alias("_at"),
            F.min(F.length(text)).alias("_lo"),
            F.max(size).alias("_hi"),
        )
    )
    # An empty table still has its columns.
    known = literal_table(df.sparkSession, ["column_name"], [(c,) for c in cols])
    total, n, texts = (F.coalesce(F.col(c), F.lit(0)) for c in ("_total", "_n", "_t"))
    return known.join(found, "column_name", "left").select(
        "column_name",
        F.when(n == 0, "empty")
        .otherwise(ladder(ratio(F.col("_d"), n), CARDINALITY_STEPS, "low"))
        .alias("cardinality_class"),
        F.when(total == 0, "empty").otherwise(ladder(ratio(n, total), NULL_STEPS, "sparse")).alias("null_class"),
        F.when(n == 0, "empty")
        .when(F.col("_w") == 0, "fixed_length")
        .when(F.col("_w") <= 2, "similar_length")
        .otherwise("variable_length")
        .alias("length_class"),
        F.when(texts == 0, "empty")
        .when(F.col("_id"), "numeric_id")
        .when(F.col("_at"), "email")
        .when(F.col("_lo") > LONG_TEXT, "long_text")
        .when(F.col("_hi") < SHORT_CODE, "short_code")
        .otherwise("general_text")
        .alias("content_class"),
        total.cast("bigint").alias("total_count"),
    )


def stability_classes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Cardinality, null-ratio and length classes that stay put under small changes."""
    return column_classes(df, cols).select("column_name", "cardinality_class", "null_class", "length_class")


def content_class(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """What kind of content all non-empty values of a column are."""
    return column_classes(df, cols).select("column_name", "content_class")


def _days_old(ts: str, now: Column) -> Column:
    return F.datediff(now, F.max(ts)).cast("bigint")


def _fresh_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "unknown")
        .when(days < FRESH_DAYS, "fresh")
        .when(days < MODERATE_DAYS, "moderate")
        .otherwise("stale")
    )


def freshness(df: DataFrame, ts: str, as_of: dt.datetime | str | None = None) -> DataFrame:
    """Age of the newest row and its class."""
    kind = df.schema[ts].dataType
    now = resolve_as_of(df, ts, as_of)
    at = F.lit(None).cast(kind) if now is None else ts_lit(now, kind)
    row = df.agg(_days_old(ts, at).alias("days_old"))
    return row.select("days_old", _fresh_label(F.col("days_old")).alias("freshness"))


def quality_assessment(
    df: DataFrame,
    ts: str,
    declared: dict[str, str],
    as_of: dt.datetime | str | None = None,
    cols: list[str] | None = None,
) -> DataFrame:
    """Completeness, consistency, timeliness, validity and their mean, in one pass.

    Validity is the mean share of values that match the declared type.
    """
    df, cols = _columns(df, cols)
    kind = df.schema[ts].dataType
    now = resolve_as_of(df, ts, as_of)
    at = F.lit(None).cast(kind) if now is None else ts_lit(now, kind)
    valid = [
        F.coalesce(ratio(count_if(matches_type(F.col(c).cast("string"), k)), F.count(c)), F.lit(0.0))
        for c, k in declared.items()
    ]
    row = df.agg(
        _completeness(cols).alias("completeness"),
        _consistency(cols).alias("consistency"),
        _days_old(ts, at).alias("_days"),
        (sum(valid, F.lit(0.0)) / len(valid)).alias("validity"),
    )
    label = _fresh_label(F.col("_days"))
    scored = row.withColumn(
        "timeliness", F.when(label == "fresh", 1.0).when(label == "moderate", 0.5).otherwise(0.0)
    )
    parts = ["completeness", "consistency", "timeliness", "validity"]
    overall = sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts)
    return scored.select(*[as_double(p).alias(p) for p in parts], as_double(overall).alias("overall"))
