"""Query-log queries; the event table stands for the log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from auditlake.functions.exprs import day_text
from auditlake.operators import usage as u
from auditlake.plans import Registry
from auditlake.plans.shapes import mean
from auditlake.sources.tables import load

REG = Registry()



def ok():
    return F.col("event_type") != "error"


def _events(spark, d):
    return load(spark, d, "events")


@REG.add(
    "h1_history_page",
    """
    WITH r AS (SELECT event_id, ts, user_id, event_type, value FROM events
               WHERE event_type <> 'error' AND contains(props, '7') AND value > 5)
    SELECT *, (SELECT count(*) FROM r) AS total,
           CAST(ceil((SELECT count(*) FROM r) / 25) AS BIGINT) AS total_pages,
           2 < ceil((SELECT count(*) FROM r) / 25) AS has_next, true AS has_prev
    FROM r ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25
    """,
)
def h1(spark, d):
    pred = ok() & F.col("props").contains("7") & (F.col("value") > 5)
    return u.history_page(_events(spark, d), pred, "ts", "event_id", 2, 25).drop("props")


DAY = "strftime(ts, '%Y-%m-%d')"


@REG.add(
    "h2_daily_usage",
    f"SELECT {DAY} AS day, count(*) AS queries, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def h2(spark, d):
    return u.daily_usage(_events(spark, d), "ts", "user_id")


@REG.add(
    "h3_top_share",
    """
    SELECT user_id, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS share
    FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10
    """,
)
def h3(spark, d):
    return u.top_share(_events(spark, d), "user_id", 10)


@REG.add(
    "h4_type_mix",
    """
    SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS share
    FROM events GROUP BY 1
    """,
)
def h4(spark, d):
    return u.type_mix(_events(spark, d), "event_type")


@REG.add(
    "h5_hour_profile",
    f"SELECT hour(ts) // 4 * 4 AS hour_of_day, count(*) AS n, {mean('value')} AS avg_time FROM events GROUP BY 1",
)
def h5(spark, d):
    return u.hour_profile(_events(spark, d), "ts", "value")


BUCKET = "time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2000-01-01')"


@REG.add(
    "h6_latency",
    f"""
    SELECT {BUCKET} AS bucket, count(*) AS n, {mean('value')} AS avg_time,
           round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY 1
    """,
)
def h6(spark, d):
    return u.latency(_events(spark, d), "ts", "value")


@REG.add("h6_latency_approx")
def h6_approx(spark, d):
    return u.latency(_events(spark, d), "ts", "value", exact=False)


@REG.add(
    "h6_latency_overall",
    f"""
    SELECT min(value) AS min_time, max(value) AS max_time, {mean('value')} AS avg_time,
           round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate,
           round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events
    """,
)
def h6_overall(spark, d):
    return u.latency_overall(_events(spark, d), "value", ok())


@REG.add(
    "h7_throughput",
    f"""
    SELECT {BUCKET} AS bucket, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors
    FROM events GROUP BY 1
    """,
)
def h7(spark, d):
    return u.throughput(_events(spark, d), "ts", ok())


@REG.add(
    "h8_usage_summary",
    f"""
    SELECT {DAY} AS period, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful,
           count(*) FILTER (WHERE event_type = 'error') AS failed, {mean('value')} AS avg_time,
           round(count(*) FILTER (WHERE value < 10) / count(*), 6) AS hit_ratio,
           round(avg(CASE event_type WHEN 'purchase' THEN 5 WHEN 'error' THEN 1 END), 6) AS satisfaction
    FROM events GROUP BY 1
    """,
)
def h8(spark, d):
    rating = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "error", 1)
    return u.usage_summary(_events(spark, d), day_text("ts"), ok(), "value", F.col("value") < 10, rating)


RUNNING = """
    SELECT event_id, {per}CAST(round(CAST(CAST(CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE)
        / count(value) OVER w AS VARCHAR) AS DECIMAL(38,20)), 6) AS DOUBLE) AS running_mean
    FROM events WINDOW w AS ({part} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


@REG.add("h9_running_mean", RUNNING.format(per="", part=""))
def h9(spark, d):
    df = _events(spark, d).select("event_id", "ts", "value")
    return u.running_mean(df, "ts", "event_id", "value").select("event_id", "running_mean")


@REG.add("h9_running_mean_per_type", RUNNING.format(per="event_type, ", part="PARTITION BY event_type"))
def h9_type(spark, d):
    df = _events(spark, d).select("event_id", "ts", "value", "event_type")
    out = u.running_mean(df, "ts", "event_id", "value", ["event_type"])
    return out.select("event_id", "event_type", "running_mean")


@REG.add("h10_keep_last", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def h10(spark, d):
    return u.keep_last(_events(spark, d).select("event_id", "ts", "user_id"), "ts", "event_id")


@REG.add(
    "h10_keep_last_per_user",
    """
    SELECT event_id, ts, user_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10
    """,
)
def h10_user(spark, d):
    df = _events(spark, d).select("event_id", "ts", "user_id")
    return u.keep_last(df, "ts", "event_id", u.SHOW_LAST, "user_id")


@REG.add(
    "h11_period_change",
    """
    WITH b AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS n FROM events GROUP BY 1),
         p AS (SELECT *, lag(n) OVER (ORDER BY bucket) AS previous FROM b)
    SELECT *, round((n - previous) * 100.0 / nullif(previous, 0), 6) AS change_percent FROM p
    """,
)
def h11(spark, d):
    return u.period_change(_events(spark, d), "ts")


@REG.add(
    "h12_feedback_summary",
    f"""
    SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS category, count(*) AS n, count(quality) AS rated,
           {mean('quality')} AS avg_rating, count(*) FILTER (WHERE quality > 0) AS positive
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang)
    """,
)
def h12(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return u.feedback_summary(docs.join(load(spark, d, "labels"), "doc_id", "left"), "quality", "lang")


@REG.add(
    "h12_rating_counts",
    "SELECT quality AS rating, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality",
)
def h12_ratings(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    return u.rating_counts(docs.join(load(spark, d, "labels"), "doc_id", "left"), "quality")


# Keywords that occur in the corpus, by intent and domain.
PATTERNS = {
    "sql_generation": ["what", "and", "which"],
    "analysis": ["there", "ation", "this"],
    "visualization": ["der", "dans", "port"],
}
DOMAINS = {"financial": ["thandthe", "nent"], "marketing": ["lead", "tion"]}


def _any_sql(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _intent_sql() -> str:
    cols = []
    for intent, words in PATTERNS.items():
        hits = " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words)
        score = f"{u.INTENT_BASE.get(intent, 0.0)} + 0.2 * ({hits})"
        if intent == "analysis":
            score += f" + CASE WHEN {_any_sql(DOMAINS['financial'])} THEN 0.3 ELSE 0 END"
        if intent == "visualization":
            domain = " OR ".join(_any_sql(w) for w in DOMAINS.values())
            score += f" + CASE WHEN ({domain}) AND {_any_sql(u.REPORT_WORDS)} THEN 0.4 ELSE 0 END"
        cols.append(f"round(CAST({score} AS DOUBLE), 6) AS s_{intent}")
    top = "greatest(" + ", ".join(f"s_{i}" for i in PATTERNS) + ")"
    share = lambda i: f"round(CASE WHEN {top} > 0 THEN s_{i} / {top} ELSE 0.0 END, 6)"
    primary = "CASE " + " ".join(f"WHEN s_{i} = {top} THEN '{i}'" for i in PATTERNS) + " END"
    second = ", ".join(f"CASE WHEN {share(i)} > 0.3 AND {primary} <> '{i}' THEN '{i}' END" for i in PATTERNS)
    scores = ", ".join(f"{share(i)} AS {i}_score" for i in PATTERNS)
    return f"""
    SELECT doc_id, {primary} AS primary_intent, concat_ws(',', {second}) AS secondary_intents, {scores}
    FROM (SELECT doc_id, {", ".join(cols)} FROM (SELECT doc_id, lower(text) AS t FROM documents))
    """


@REG.add("h13_intent_scores", _intent_sql())
def h13(spark, d):
    out = u.intent_scores(load(spark, d, "documents").select("doc_id", "text"), "text", PATTERNS, DOMAINS)
    return out.withColumn("secondary_intents", F.array_join("secondary_intents", ",")).drop("text")


# Statements written from the event rows, so that the log grows with the table.
STATEMENTS = """
    SELECT event_id, CASE event_type WHEN 'view' THEN concat('SELECT * FROM pages WHERE id = ', user_id)
        WHEN 'click' THEN concat('  with x as (select created_at from t) select * from x where v > ', value)
        WHEN 'signup' THEN concat('INSERT INTO users VALUES (', user_id, ')')
        WHEN 'purchase' THEN concat('update stock set updated_at = now() where id = ', user_id)
        ELSE concat('EXPLAIN ', props) END AS statement, value
    FROM events
"""


def _statements(spark, d):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit("SELECT * FROM pages WHERE id = "), user))
        .when(
            kind == "click",
            F.concat(
                F.lit("  with x as (select created_at from t) select * from x where v > "),
                F.col("value").cast("string"),
            ),
        )
        .when(kind == "signup", F.concat(F.lit("INSERT INTO users VALUES ("), user, F.lit(")")))
        .when(kind == "purchase", F.concat(F.lit("update stock set updated_at = now() where id = "), user))
        .otherwise(F.concat(F.lit("EXPLAIN "), F.col("props")))
    )
    return _events(spark, d).select("event_id", text.alias("statement"), "value")


def _rule_sql() -> str:
    cases = " ".join(
        f"WHEN regexp_matches(upper(statement), '\\b{w}\\b') THEN '{w.lower()}'" for w in u.WRITE_KEYWORDS
    )
    return (
        f"CASE WHEN statement IS NULL THEN 'empty' {cases} "
        "WHEN NOT regexp_matches(upper(statement), '^\\s*(SELECT|WITH)') THEN 'not_a_select' ELSE 'ok' END"
    )


@REG.add(
    "h14_audit_statements",
    f"SELECT *, rule = 'ok' AS is_safe FROM (SELECT event_id, statement, {_rule_sql()} AS rule FROM ({STATEMENTS}))",
)
def h14(spark, d):
    return u.audit_statements(_statements(spark, d).drop("value"), "statement")


@REG.add(
    "h14_audit_counts",
    f"SELECT rule, count(*) AS n FROM (SELECT {_rule_sql()} AS rule FROM ({STATEMENTS})) GROUP BY 1",
)
def h14_counts(spark, d):
    return u.audit_counts(u.audit_statements(_statements(spark, d), "statement"))


MASK = "regexp_replace(regexp_replace({c}, '''[^'']*''', '?', 'g'), '[0-9]+', '?', 'g')"


@REG.add(
    "h15_statement_patterns",
    f"SELECT {MASK.format(c='statement')} AS pattern, count(*) AS n, {mean('value')} AS avg_cost FROM ({STATEMENTS}) GROUP BY 1",
)
def h15(spark, d):
    return u.statement_patterns(_statements(spark, d), "statement", "value")


@REG.add(
    "h15_url_patterns",
    f"SELECT {MASK.format(c='url')} AS pattern, count(*) AS n, {mean('length(html)')} AS avg_cost FROM pages GROUP BY 1",
)
def h15_url(spark, d):
    pages = load(spark, d, "pages").select("url", F.length("html").alias("size"))
    return u.statement_patterns(pages, "url", "size")


@REG.add("h16_expired_count", "SELECT count(*) AS removed FROM events WHERE ts < TIMESTAMP '2024-01-20'")
def h16(spark, d):
    return u.expired_count(_events(spark, d), "ts", dt.timedelta(days=5), "2024-01-25")


@REG.add("h16_expired", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-03'")
def h16_rows(spark, d):
    return u.expired(_events(spark, d), "ts", dt.timedelta(days=22), "2024-01-25").select("event_id", "ts")


@REG.add(
    "h17_evict_plan",
    """
    WITH s AS (SELECT doc_id, n_chars, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id * 7919 % 1000) AS seen FROM documents),
         c AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY seen, doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS freed FROM s)
    SELECT doc_id, n_chars FROM c WHERE freed - n_chars < CAST(400000 * 1.25 AS BIGINT)
    """,
)
def h17(spark, d):
    hours = (F.col("doc_id") * 7919 % 1000).cast("int")
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)
    docs = load(spark, d, "documents").select("doc_id", "n_chars", seen.alias("seen"))
    return u.evict_plan(docs, "seen", "doc_id", "n_chars", 400_000).select("doc_id", "n_chars")


@REG.add(
    "h18_actor_performance",
    f"""
    SELECT user_id, count(*) AS total, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate,
           {mean('value')} AS avg_time, count(*) FILTER (WHERE event_type = 'error') AS errors,
           count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last_day
    FROM events GROUP BY 1
    """,
)
def h18(spark, d):
    return u.actor_performance(_events(spark, d), "user_id", "ts", ok(), "value")


@REG.add(
    "h19_alerts",
    f"""
    WITH b AS (SELECT user_id, date_trunc('day', ts) AS bucket, value FROM events),
         m AS (SELECT bucket, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS mean FROM b GROUP BY 1),
         p AS (SELECT bucket, (mean - lag(mean) OVER (ORDER BY bucket)) * 100 / lag(mean) OVER (ORDER BY bucket)
                   AS change_percent FROM m)
    SELECT 'slow_entry' AS alert, CAST(event_id AS VARCHAR) AS subject, value FROM events WHERE value > 300
    UNION ALL
    SELECT 'rising_mean', strftime(bucket, '%Y-%m-%d'), round(change_percent, 6) FROM p WHERE round(change_percent, 6) >= 8
    """,
)
def h19(spark, d):
    return u.alerts(_events(spark, d), "ts", "event_id", "value", 300, 8)
