"""Query-log analytics: volume, latency, trends, retention, audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.exprs import (
    count_if, day_text, fixed_part, mean_of, rest_part, as_double, ratio, resolve_as_of, trunc, ts_lit,
)
from auditlake.functions.ordering import bracket_sketch, exact_quantiles, prefix_sums
from auditlake.functions.text import contains_any, hit_count
from auditlake.session import materialize

# Log sizes, bucket widths and limits.
KEEP_LAST, SHOW_LAST = 1000, 10
HOUR_BUCKET, LATENCY_HOURS = 4, 2
EVICT_OVERHEAD = 1.25
RISE_PERCENT = 40.0
ACTOR_WINDOW = dt.timedelta(hours=24)
INTENT_BASE = {"sql_generation": 0.3}
INTENT_KEYWORD, DOMAIN_BONUS, REPORT_BONUS, SECONDARY_ABOVE = 0.2, 0.3, 0.4, 0.3
REPORT_WORDS = ["dashboard", "report"]
BONUS_DOMAINS = ["financial", "hr_management"]
# Statements that change data or schema; reads start with one of the openers.
WRITE_KEYWORDS = [
    "DROP", "DELETE", "TRUNCATE", "INSERT", "UPDATE", "ALTER", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE",
]
READ_OPENERS = ["SELECT", "WITH"]


def time_bucket(ts: str, hours: int) -> Column:
    """Start of the n-hour bucket of the day a time falls in."""
    day = trunc("day", ts)
    return (day + F.make_dt_interval(F.lit(0), F.floor(F.hour(ts) / hours).cast("int") * hours)).cast("timestamp_ntz")


def history_page(
    log: DataFrame, pred: Column, ts: str, key: str, page: int, size: int
) -> DataFrame:
    """One page of the matching entries, newest first, with totals and page flags."""
    rows = log.filter(pred)
    total = rows.agg(F.count("*").alias("n")).scalar()
    pages = F.ceil(F.col("total") / size)
    return (
        rows.orderBy(F.col(ts).desc(), F.col(key))
        .offset((page - 1) * size)
        .limit(size)
        .withColumn("total", total)
        .withColumn("total_pages", pages)
        .withColumn("has_next", F.lit(page) < pages)
        .withColumn("has_prev", F.lit(page > 1))
    )


def daily_usage(log: DataFrame, ts: str, user: str) -> DataFrame:
    return log.groupBy(day_text(ts).alias("day")).agg(
        F.count("*").alias("queries"), F.countDistinct(user).alias("users")
    )


def top_share(log: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values with their share of all rows."""
    counts = log.groupBy(key).agg(F.count("*").alias("n"))
    total = log.agg(F.count("*").alias("t")).scalar()
    top = counts.orderBy(F.desc("n"), F.col(key)).limit(n)
    return top.withColumn("share", as_double(ratio(F.col("n") * 100, total)))


def type_mix(log: DataFrame, kind: str) -> DataFrame:
    """Rows per type with their share."""
    counts = log.groupBy(kind).agg(F.count("*").alias("n"))
    total = log.agg(F.count("*").alias("t")).scalar()
    return counts.withColumn("share", as_double(ratio(F.col("n") * 100, total)))


def hour_profile(log: DataFrame, ts: str, duration: str, hours: int = HOUR_BUCKET) -> DataFrame:
    """Count and mean duration per time of day."""
    slot = (F.floor(F.hour(ts) / hours) * hours).cast("bigint")
    return log.groupBy(slot.alias("hour_of_day")).agg(F.count("*").alias("n"), mean_of(duration).alias("avg_time"))


def latency(
    log: DataFrame, ts: str, duration: str, hours: int = LATENCY_HOURS, exact: bool = True
) -> DataFrame:
    """Mean, p95 and p99 duration per bucket; percentiles exact or from sketches."""
    rows = log.select(time_bucket(ts, hours).alias("bucket"), F.col(duration).alias("_d"))
    if not exact:
        tail = F.percentile_approx("_d", [0.95, 0.99], 10_000)
        return rows.groupBy("bucket").agg(
            F.count("*").alias("n"), mean_of("_d").alias("avg_time"), tail[0].alias("p95"), tail[1].alias("p99")
        )
    probs = {"p95": 0.95, "p99": 0.99}
    # One pass for the figures and the brackets, one for the values in them.
    base = materialize(
        rows.groupBy("bucket").agg(
            F.count("*").alias("n"),
            mean_of("_d").alias("avg_time"),
            F.count("_d").alias("_size"),
            bracket_sketch(F.col("_d"), probs).alias("_ends"),
        )
    )
    stats = base.filter("_size > 0").select("bucket", "_size", "_ends")
    tail = exact_quantiles(rows, ["bucket"], "_d", probs, stats)
    return base.drop("_size", "_ends").join(tail, "bucket", "left")


def latency_overall(log: DataFrame, duration: str, ok: Column) -> DataFrame:
    """Min, max, mean, median, p95 and success rate over the whole log."""
    marks = exact_quantiles(log, [], duration, {"median": 0.5, "p95": 0.95})
    row = log.agg(
        F.min(duration).cast("double").alias("min_time"),
        F.max(duration).cast("double").alias("max_time"),
        mean_of(duration).alias("avg_time"),
        as_double(ratio(count_if(ok), F.count("*"))).alias("success_rate"),
    )
    found = marks.select(F.struct("median", "p95").alias("m")).scalar()
    return row.withColumn("_m", found).select("*", "_m.median", "_m.p95").drop("_m")


def throughput(log: DataFrame, ts: str, ok: Column, hours: int = LATENCY_HOURS) -> DataFrame:
    """Requests and errors per bucket."""
    return log.groupBy(time_bucket(ts, hours).alias("bucket")).agg(
        F.count("*").alias("requests"), count_if(~ok).alias("errors")
    )


def usage_summary(
    log: DataFrame, period: Column, ok: Column, duration: str, hit: Column, rating: Column
) -> DataFrame:
    """Per period: totals, mean time, share of hits and mean rating."""
    return log.groupBy(period.alias("period")).agg(
        F.count("*").alias("total"),
        count_if(ok).alias("successful"),
        count_if(~ok).alias("failed"),
        mean_of(duration).alias("avg_time"),
        as_double(ratio(count_if(hit), F.count("*"))).alias("hit_ratio"),
        as_double(F.avg(rating)).alias("satisfaction"),
    )


def running_mean(log: DataFrame, ts: str, key: str, value: str, per: list[str] | None = None) -> DataFrame:
    """Mean of all entries so far, after each entry."""
    per = per or []
    sums = {"_s": fixed_part(value), "_r": rest_part(value), "_n": F.col(value).isNotNull().cast("bigint")}
    out = prefix_sums(log, per, [F.col(ts), F.col(key)], sums)
    whole = F.coalesce(F.col("_s").cast("double"), F.lit(0.0)) + F.col("_r")
    return out.withColumn("running_mean", ratio(whole, F.col("_n"))).drop("_s", "_r", "_n")


def keep_last(log: DataFrame, ts: str, key: str, n: int = KEEP_LAST, per: str | None = None) -> DataFrame:
    """The newest n entries, of all or of each group."""
    order = [F.col(ts).desc(), F.col(key).desc()]
    if per is None:
        return log.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return log.withColumn("_p", place).filter(F.col("_p") <= n).drop("_p")


def _change(buckets: DataFrame, value: str) -> DataFrame:
    # One row per time bucket: the calendar bounds the window.
    before = F.lag(value).over(Window.orderBy("bucket"))
    return buckets.withColumn("previous", before).withColumn(
        "change_percent", as_double(ratio((F.col(value) - F.col("previous")) * 100, F.col("previous")))
    )


def period_change(log: DataFrame, ts: str, grain: str = "day") -> DataFrame:
    """Rows per period and the change against the one before."""
    return _change(log.groupBy(trunc(grain, ts).alias("bucket")).agg(F.count("*").alias("n")), "n")


def feedback_summary(df: DataFrame, rating: str, category: str) -> DataFrame:
    """Count and mean rating per category and for all."""
    rows = df.rollup(category).agg(
        F.count("*").alias("n"),
        F.count(rating).alias("rated"),
        mean_of(rating).alias("avg_rating"),
        count_if(F.col(rating) > 0).alias("positive"),
        F.grouping(category).alias("_g"),
    )
    name = F.when(F.col("_g") == 1, "all").otherwise(F.col(category))
    return rows.select(name.alias("category"), "n", "rated", "avg_rating", "positive")


def rating_counts(df: DataFrame, rating: str) -> DataFrame:
    """How often each rating was given; no rating is a value of its own."""
    return df.groupBy(F.col(rating).alias("rating")).agg(F.count("*").alias("n"))


def intent_scores(
    df: DataFrame,
    text: str,
    patterns: dict[str, list[str]],
    domains: dict[str, list[str]],
    base: dict[str, float] = INTENT_BASE,
) -> DataFrame:
    """Intent of each text: keyword scores normalised by the best, primary and secondary ones.

    Ties for the primary intent go to the first in the order given.
    """
    out = df.withColumn("_low", F.lower(F.col(text)))
    low = F.col("_low")
    in_bonus = F.lit(False)
    for name in BONUS_DOMAINS:
        in_bonus = in_bonus | contains_any(low, domains.get(name, []))
    any_domain = F.lit(False)
    for words in domains.values():
        any_domain = any_domain | contains_any(low, words)
    for intent, words in patterns.items():
        score = F.lit(base.get(intent, 0.0)) + INTENT_KEYWORD * hit_count(low, words)
        if intent == "analysis":
            score = score + F.when(in_bonus, DOMAIN_BONUS).otherwise(0.0)
        if intent == "visualization":
            score = score + F.when(any_domain & contains_any(low, REPORT_WORDS), REPORT_BONUS).otherwise(0.0)
        out = out.withColumn(f"_{intent}", as_double(score))
    names = list(patterns)
    top = F.greatest(*[F.col(f"_{i}") for i in names])
    out = out.withColumn("_top", top)
    share = {i: as_double(F.when(F.col("_top") > 0, F.col(f"_{i}") / F.col("_top")).otherwise(0.0)) for i in names}
    primary = F.when(F.col(f"_{names[0]}") == F.col("_top"), names[0])
    for i in names[1:]:
        primary = primary.when(F.col(f"_{i}") == F.col("_top"), i)
    out = out.withColumn("primary_intent", primary)
    second = [
        F.when((share[i] > SECONDARY_ABOVE) & (F.col("primary_intent") != i), F.lit(i)) for i in names
    ]
    out = out.withColumn("secondary_intents", F.array_compact(F.array(*second)))
    scores = [share[i].alias(f"{i}_score") for i in names]
    return out.select(*df.columns, "primary_intent", "secondary_intents", *scores)


def audit_statements(df: DataFrame, sql_col: str) -> DataFrame:
    """Adds whether a statement only reads, and the rule it breaks if not."""
    upper = df.withColumn("_upper", F.upper(F.col(sql_col)))
    text = F.col("_upper")
    rule = F.when(text.isNull(), "empty")
    for word in WRITE_KEYWORDS:
        rule = rule.when(text.rlike(rf"\b{word}\b"), word.lower())
    opener = r"^\s*(" + "|".join(READ_OPENERS) + ")"
    rule = rule.when(~text.rlike(opener), "not_a_select").otherwise("ok")
    return upper.withColumn("rule", rule).withColumn("is_safe", F.col("rule") == "ok").drop("_upper")


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("rule").agg(F.count("*").alias("n"))


def statement_patterns(df: DataFrame, col: str, cost: str, n: int | None = None) -> DataFrame:
    """Texts with literals masked: frequency and mean cost per pattern."""
    masked = F.regexp_replace(F.regexp_replace(F.col(col), "'[^']*'", "?"), "[0-9]+", "?")
    out = df.groupBy(masked.alias("pattern")).agg(F.count("*").alias("n"), mean_of(cost).alias("avg_cost"))
    return out if n is None else out.orderBy(F.desc("n"), "pattern").limit(n)


def expired(df: DataFrame, created: str, ttl: dt.timedelta, as_of: dt.datetime | str) -> DataFrame:
    """Entries whose lifetime ended before ``as_of``."""
    now = resolve_as_of(df, created, as_of)
    return df.filter(F.col(created) < ts_lit(now - ttl, df.schema[created].dataType))


def expired_count(df: DataFrame, created: str, ttl: dt.timedelta, as_of: dt.datetime | str) -> DataFrame:
    return expired(df, created, ttl, as_of).agg(F.count("*").alias("removed"))


def evict_plan(df: DataFrame, ts: str, key: str, size: str, needed: int) -> DataFrame:
    """Oldest entries first until 1.25 times the needed size is freed.

    Day totals find the day the target is met in; only the entries of that one
    day are ranked one by one.
    """
    target = F.lit(int(needed * EVICT_OVERHEAD)).cast("bigint")
    days = df.groupBy(trunc("day", ts).alias("_day")).agg(F.sum(size).alias("_size"))
    before = F.coalesce(
        F.sum("_size").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # One row per day of data.
    hit = days.select("_day", before.alias("_before")).filter(F.col("_before") < target)
    last = hit.agg(F.max(F.struct("_day", "_before")).alias("m")).first()["m"]
    if last is None:
        return df.withColumn("freed", F.lit(0).cast("bigint")).limit(0)
    kind = df.schema[ts].dataType
    start = ts_lit(last["_day"], kind)
    whole = df.filter(F.col(ts) < start).withColumn("freed", F.lit(None).cast("bigint"))
    edge = df.filter((F.col(ts) >= start) & (trunc("day", ts) == start))
    ranked = prefix_sums(edge, [], [F.col(ts), F.col(key)], {"freed": F.col(size).cast("bigint")})
    ranked = ranked.withColumn("freed", F.col("freed") + F.lit(int(last["_before"])))
    return whole.unionByName(ranked.filter(F.col("freed") - F.col(size) < target))


def actor_performance(
    log: DataFrame, actor: str, ts: str, ok: Column, duration: str, as_of: dt.datetime | str | None = None
) -> DataFrame:
    """Per actor: success rate, mean time, errors, and rows in the last day."""
    now, kind = resolve_as_of(log, ts, as_of), log.schema[ts].dataType
    # An empty log has no last day.
    since = F.lit(None).cast(kind) if now is None else ts_lit(now - ACTOR_WINDOW, kind)
    return log.groupBy(actor).agg(
        F.count("*").alias("total"),
        as_double(ratio(count_if(ok), F.count("*"))).alias("success_rate"),
        mean_of(duration).alias("avg_time"),
        count_if(~ok).alias("errors"),
        count_if(F.col(ts) >= since).alias("last_day"),
    )


def alerts(
    log: DataFrame, ts: str, key: str, duration: str, slow: float, rise: float = RISE_PERCENT, grain: str = "day"
) -> DataFrame:
    """Entries slower than the limit, and periods whose mean rose sharply over the one before."""
    late = log.filter(F.col(duration) > slow).select(
        F.lit("slow_entry").alias("alert"),
        F.col(key).cast("string").alias("subject"),
        F.col(duration).cast("double").alias("value"),
    )
    means = log.groupBy(trunc(grain, ts).alias("bucket")).agg(mean_of(duration).alias("mean"))
    risen = _change(means, "mean").filter(F.col("change_percent") >= rise).select(
        F.lit("rising_mean").alias("alert"), day_text("bucket").alias("subject"), F.col("change_percent").alias("value")
    )
    return late.unionByName(risen)

