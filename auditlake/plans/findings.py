"""Findings over several tables, and the reports drawn from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import findings as f
from auditlake.operators import integrity, relate
from auditlake.plans import Registry
from auditlake.plans.fraud import benford_sql, orphan_sql, zscore_sql
from auditlake.plans.relations import KEYS, REFERENCES, discovered_sql, tables as key_tables
from auditlake.sources.tables import load

REG = Registry()


def found(spark, d):
    orders, lines = load(spark, d, "orders"), load(spark, d, "lineitem")
    docs, events = load(spark, d, "documents"), load(spark, d, "events")
    labelled = docs.select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    return f.findings(
        {
            "orders": f.Roles(
                orders, amount="o_totalprice", created="o_orderdate", user="o_custkey", ts="o_orderdate",
                key=["o_orderkey"], duplicate_of=["o_totalprice", "o_orderdate"], measures=["o_totalprice"],
                fks=[("o_custkey", "customer", load(spark, d, "customer"), "c_custkey")],
            ),
            "lineitem": f.Roles(
                lines, amount="l_extendedprice", duplicate_of=["l_quantity", "l_shipdate"],
                key=["l_orderkey", "l_linenumber"], ts="l_shipdate", as_of="2001-01-01",
            ),
            "documents": f.Roles(
                docs, amount="n_chars", measures=["n_chars"],
                fks=[("doc_id", "labels", load(spark, d, "labels"), "doc_id")],
            ),
            "events": f.Roles(events, amount="value", user="user_id", ts="ts", measures=["value"], key=["event_id"], clock="ts"),
            "labelled": f.Roles(labelled, critical=["quality", "toxic"], audit=["quality", "toxic"]),
            "stock": f.Roles(lines.select("l_orderkey", "l_partkey", "l_suppkey"), check_references=True),
        }
    )


def _row(table, columns, kind, risk, rows, stat, source):
    category, likelihood, confidence = f.VERDICTS[kind]
    return f"""
    SELECT '{table}.{"+".join(columns)}.{kind}' AS finding_id, '{table}' AS table_name, '{kind}' AS kind,
           '{category}' AS category, {risk} AS risk_level, CAST({likelihood} AS DOUBLE) AS likelihood,
           CAST({confidence} AS DOUBLE) AS confidence, '{",".join(columns)}' AS affected_columns,
           CAST({rows} AS BIGINT) AS affected_rows, CAST({stat} AS DOUBLE) AS statistic
    FROM ({source})
    """


def _benford(table, column):
    body = benford_sql(table, column) + (
        "SELECT *, CASE WHEN chi_square < 25 THEN 'medium' ELSE 'high' END AS risk FROM chi "
        "WHERE digits >= 7 AND chi_square > 15.51"
    )
    return _row(table, [column], "benfords_law_violation", "risk", "rows_tested", "chi_square", body)


def _outliers(table, column):
    body = f"SELECT * FROM ({zscore_sql(table, column)}) WHERE risk_level <> 'none'"
    return _row(table, [column], "statistical_outliers", "risk_level", "outlier_count", "max_z_score", body)


def _orphans(table, column, parent, key):
    body = f"SELECT * FROM ({orphan_sql(table, column, parent, key)}) WHERE orphan_count > 0"
    return _row(table, [column], "orphaned_records", "risk_level", "orphan_count", "NULL", body)


def _groups(table, columns, kind):
    body = (
        f"SELECT count(*) AS n FROM (SELECT 1 FROM {table} GROUP BY {', '.join(columns)} HAVING count(*) > 1) "
        "HAVING count(*) > 0"
    )
    return _row(table, columns, kind, "'high'", "n", "NULL", body)


def _velocity(table, user, ts):
    body = f"""
    SELECT count(*) AS n FROM (
        SELECT {user} FROM {table} WHERE {ts} >= (SELECT max({ts}) FROM {table}) - INTERVAL 1 HOUR GROUP BY 1
        HAVING count(*) > 10 AND epoch_us(max({ts})) - epoch_us(min({ts})) < 3600e6) HAVING count(*) > 0
    """
    return _row(table, [user, ts], "velocity_fraud", "'high'", "n", "NULL", body)


def _round(table, column):
    body = f"""
    SELECT * FROM (SELECT count(*) FILTER (WHERE CAST({column} AS DECIMAL(20,4)) % 100 = 0) AS n,
        count(*) FILTER (WHERE CAST({column} AS DECIMAL(20,4)) % 100 = 0) * 100.0 / count({column}) AS share
        FROM {table}) WHERE share > 20
    """
    return _row(
        table, [column], "round_amount_fraud", "CASE WHEN share < 40 THEN 'medium' ELSE 'high' END", "n",
        "round(share, 6)", body,
    )


def _split(table, user, ts, amount):
    body = f"""
    SELECT count(*) AS n FROM (
        SELECT {user} FROM {table} WHERE {amount} BETWEEN 9000 AND 9999 OR {amount} BETWEEN 4900 AND 4999
        GROUP BY {user}, CAST({ts} AS DATE) HAVING count(*) >= 3) HAVING count(*) > 0
    """
    return _row(table, [user, amount], "split_transactions", "'critical'", "n", "NULL", body)


NIGHT = _row(
    "events", ["ts"], "off_hours_transactions", "'medium'", "n", "NULL",
    "SELECT count(*) AS n FROM events WHERE hour(ts) BETWEEN 0 AND 5 OR hour(ts) BETWEEN 22 AND 23 HAVING count(*) > 0",
)
AUDIT = _row(
    "labelled", ["quality", "toxic"], "missing_audit_fields", "'high'", "n", "round(100.0 * n / total, 6)",
    """SELECT * FROM (SELECT count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) AS n, count(*) AS total
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE n > 0""",
)
LOOSE = _row(
    "stock", ["l_orderkey", "l_partkey", "l_suppkey"], "missing_foreign_key_constraints", "'medium'", "n", "3",
    "SELECT count(*) AS n FROM lineitem",
)


def _nulls(column):
    body = f"""
    SELECT count(*) - count({column}) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    HAVING count(*) - count({column}) > 0
    """
    return _row("labelled", [column], "critical_field_allows_null", "'medium'", "n", "NULL", body)


FOUND = " UNION ALL ".join(
    f"({s})"
    for s in [
        _split("orders", "o_custkey", "o_orderdate", "o_totalprice"),
        _split("events", "user_id", "ts", "value"),
        NIGHT,
        AUDIT,
        LOOSE,
        _round("orders", "o_totalprice"),
        _benford("orders", "o_totalprice"),
        _row(
            "orders", ["o_orderdate"], "backdated_records", "'high'", "n", "NULL",
            """SELECT count(*) AS n FROM orders, (SELECT max(o_orderdate) AS now FROM orders)
               WHERE o_orderdate < now - INTERVAL 7 DAY AND o_orderdate > now - INTERVAL 365 DAY
               HAVING count(*) > 10""",
        ),
        _groups("orders", ["o_totalprice", "o_orderdate"], "duplicate_transactions"),
        _velocity("orders", "o_custkey", "o_orderdate"),
        _groups("orders", ["o_orderkey"], "duplicate_key"),
        _outliers("orders", "o_totalprice"),
        _orphans("orders", "o_custkey", "customer", "c_custkey"),
        _round("lineitem", "l_extendedprice"),
        _benford("lineitem", "l_extendedprice"),
        _groups("lineitem", ["l_quantity", "l_shipdate"], "duplicate_transactions"),
        _groups("lineitem", ["l_orderkey", "l_linenumber"], "duplicate_key"),
        _row(
            "lineitem", ["l_shipdate"], "future_dated_records", "'medium'", "n", "NULL",
            "SELECT count(*) AS n FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01' HAVING count(*) > 5",
        ),
        _round("documents", "n_chars"),
        _benford("documents", "n_chars"),
        _outliers("documents", "n_chars"),
        _orphans("documents", "doc_id", "labels", "doc_id"),
        _round("events", "value"),
        _benford("events", "value"),
        _velocity("events", "user_id", "ts"),
        _groups("events", ["event_id"], "duplicate_key"),
        _outliers("events", "value"),
        _nulls("quality"),
        _nulls("toxic"),
    ]
)
RANK = "CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
LEVELS = ", ".join(
    f"count(*) FILTER (WHERE risk_level = '{x}') AS {x}" for x in ("critical", "high", "medium", "low")
)


@REG.add("d25_findings", FOUND)
def d25(spark, d):
    return found(spark, d).withColumn("affected_columns", F.array_join("affected_columns", ","))


@REG.add(
    "d25_findings_filtered",
    f"SELECT * FROM ({FOUND}) WHERE confidence >= 0.85 AND {RANK} >= 3 AND category = 'transaction_anomaly'",
)
def d25_filtered(spark, d):
    lines = load(spark, d, "lineitem")
    orders = load(spark, d, "orders")
    out = f.findings(
        {
            "orders": f.Roles(
                orders, amount="o_totalprice", user="o_custkey", ts="o_orderdate",
                duplicate_of=["o_totalprice", "o_orderdate"],
            ),
            "lineitem": f.Roles(lines, amount="l_extendedprice", duplicate_of=["l_quantity", "l_shipdate"]),
            "documents": f.Roles(load(spark, d, "documents"), amount="n_chars"),
            "events": f.Roles(load(spark, d, "events"), amount="value", user="user_id", ts="ts"),
        },
        ["transaction_anomaly"], 0.85, "high",
    )
    return out.withColumn("affected_columns", F.array_join("affected_columns", ","))


@REG.add(
    "d26_risk_breakdown",
    f"""
    SELECT coalesce(category, 'all') AS category, count(*) AS total, {LEVELS},
           CASE max({RANK}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low'
                ELSE 'none' END AS highest_risk
    FROM ({FOUND}) GROUP BY ROLLUP (category)
    """,
)
def d26(spark, d):
    return f.risk_breakdown(found(spark, d))


@REG.add(
    "d27_risk_score",
    f"""
    WITH s AS (SELECT count(*) AS findings, 1 - exp(sum(ln(1 - likelihood * confidence * CASE risk_level
                 WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END))) AS s
               FROM ({FOUND}))
    SELECT findings, round(s, 6) AS overall_risk_score,
           CASE WHEN s >= 0.8 THEN 'CRITICAL' WHEN s >= 0.6 THEN 'HIGH' WHEN s >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END
               AS risk_band FROM s
    """,
)
def d27(spark, d):
    return f.risk_score(found(spark, d))


@REG.add(
    "d28_top_risks",
    f"""
    SELECT finding_id, kind, category, risk_level, likelihood FROM ({FOUND})
    ORDER BY {RANK} DESC, likelihood DESC, finding_id LIMIT 3
    """,
)
def d28(spark, d):
    return f.top_risks(found(spark, d))


@REG.add(
    "d29_run_stats",
    """
    SELECT count(*) AS total_runs, count(*) FILTER (WHERE event_type <> 'error') AS successful_runs,
           count(*) FILTER (WHERE event_type = 'error') AS failed_runs,
           round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 6) AS avg_time,
           (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FROM (
                SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)) AS recent
    FROM events
    """,
)
def d29(spark, d):
    out = f.run_stats(load(spark, d, "events"), F.col("event_type") != "error", "value", "ts", "event_id")
    return out.withColumn("recent", F.array_join(F.col("recent").cast("array<string>"), ","))


# Two further columns of the events, named after tables whose keys do not hold their values.
LOOSE_EVENTS = "(SELECT event_id, user_id, event_id AS page_id, user_id AS supplier_id FROM events)"
LOOSE_KEYS = {**KEYS, "events": "event_id", "pages": "page_id"}
LOOSE_LINKS = discovered_sql(
    {**REFERENCES, "events": ["event_id", "user_id", "page_id", "supplier_id"], "pages": ["page_id"]}, LOOSE_KEYS, {"events": LOOSE_EVENTS}
)


@REG.add(
    "d23_unverified_fks",
    f"""
    SELECT source_table AS table_name, count(DISTINCT source_column) AS unverified,
           string_agg(DISTINCT source_column, ', ' ORDER BY source_column) AS columns, 'medium' AS risk_level
    FROM ({LOOSE_LINKS}) WHERE coalesce(inclusion_ratio, 0) < 1 GROUP BY 1 HAVING count(DISTINCT source_column) > 2
    """,
)
def d23(spark, d):
    # Reference-like columns no parent confirms: two point at keys that lack values, one at no table.
    named = key_tables(spark, d)
    named["events"] = load(spark, d, "events").select(
        "event_id", "user_id", F.col("event_id").alias("page_id"), F.col("user_id").alias("supplier_id")
    )
    named["pages"] = load(spark, d, "pages")
    return integrity.unverified_fks(relate.discover_relationships(named, LOOSE_KEYS))
