"""Fraud and anomaly queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from auditlake.operators import integrity as g
from auditlake.operators import statistical as s
from auditlake.operators import temporal as t
from auditlake.operators import transactions as x
from auditlake.plans import Registry
from auditlake.plans.shapes import total
from auditlake.sources.tables import load

REG = Registry()


@REG.add(
    "d1_duplicates",
    """
    SELECT l_quantity, l_shipdate, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    """,
)
def d1(spark, d):
    return x.duplicates(load(spark, d, "lineitem"), ["l_quantity", "l_shipdate"])


@REG.add(
    "d1_duplicate_texts",
    """
    SELECT md5(text) AS text_md5, count(*) AS occurrences FROM documents GROUP BY 1 HAVING count(*) > 1
    """,
)
def d1_text(spark, d):
    docs = load(spark, d, "documents").select(F.md5("text").alias("text_md5"))
    return x.duplicates(docs, ["text_md5"])


@REG.add(
    "d1_duplicates_recent",
    """
    SELECT user_id, event_type, count(*) AS occurrences FROM events
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2 HAVING count(*) > 1
    """,
)
def d1_recent(spark, d):
    return x.duplicates(load(spark, d, "events"), ["user_id", "event_type"], "ts", dt.timedelta(hours=24))


@REG.add(
    "d2_round_ratio",
    """
    SELECT *, CASE WHEN round_percent <= 20 THEN 'none' WHEN round_percent < 40 THEN 'medium' ELSE 'high' END
           AS risk_level
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE CAST(l_quantity AS DECIMAL(20,4)) % 10 = 0) AS round_small,
                 count(*) FILTER (WHERE CAST(l_quantity AS DECIMAL(20,4)) % 50 = 0) AS round_big,
                 round(count(*) FILTER (WHERE CAST(l_quantity AS DECIMAL(20,4)) % 10 = 0) * 100.0 / count(*), 6)
                     AS round_percent
          FROM lineitem WHERE l_quantity IS NOT NULL)
    """,
)
def d2(spark, d):
    return x.round_ratio(load(spark, d, "lineitem"), "l_quantity", 10, 50)


@REG.add(
    "d3_round_amounts",
    """
    SELECT l_quantity, count(*) AS frequency FROM lineitem WHERE CAST(l_quantity AS DECIMAL(20,4)) % 10 = 0
    GROUP BY 1 HAVING count(*) > 10
    """,
)
def d3(spark, d):
    return x.round_amounts(load(spark, d, "lineitem"), "l_quantity", modulus=10)


@REG.add(
    "d4_velocity",
    """
    SELECT user_id, count(*) AS tx_count,
           round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 6) AS span_minutes
    FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR
    GROUP BY 1 HAVING count(*) > 5 ORDER BY tx_count DESC, user_id LIMIT 5
    """,
)
def d4(spark, d):
    return x.velocity(load(spark, d, "events"), "user_id", "ts", dt.timedelta(hours=24), 5)


@REG.add(
    "d5_velocity_all",
    """
    WITH w AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
                   RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM events)
    SELECT user_id, max(n) AS peak_count, count(DISTINCT ts) AS instants_over FROM w WHERE n > 6 GROUP BY 1
    """,
)
def d5(spark, d):
    return x.velocity_all(load(spark, d, "events"), "user_id", "ts", dt.timedelta(hours=24), 6)


@REG.add(
    "d6_structuring",
    f"""
    SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS tx_count,
           {total('l_extendedprice')} AS total_amount
    FROM lineitem WHERE l_extendedprice BETWEEN 9000 AND 9999 OR l_extendedprice BETWEEN 4900 AND 4999
    GROUP BY 1, 2 HAVING count(*) >= 2
    """,
)
def d6(spark, d):
    return x.structuring(load(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice", min_n=2)


@REG.add(
    "d6b_off_hours",
    """
    SELECT event_id, ts, user_id, value FROM events
    WHERE hour(ts) BETWEEN 0 AND 5 OR hour(ts) BETWEEN 22 AND 23 ORDER BY ts DESC, event_id LIMIT 100
    """,
)
def d6b(spark, d):
    df = load(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return x.off_hours(df, "ts", "event_id")


@REG.add(
    "d7_backdated_summary",
    """
    WITH m AS (SELECT max(o_orderdate) AS now FROM orders)
    SELECT count(*) AS backdated_count, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS earliest_backdate,
           round(CAST(sum(epoch_us(now) - epoch_us(o_orderdate)) AS DOUBLE) / count(*) / 86400e6, 6) AS avg_days_back
    FROM orders, m WHERE o_orderdate < now - INTERVAL 7 DAY AND o_orderdate > now - INTERVAL 365 DAY
    HAVING count(*) > 10
    """,
)
def d7(spark, d):
    return t.backdated_summary(load(spark, d, "orders"), "o_orderdate")


@REG.add(
    "d8_backdated_rows",
    """
    WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate FROM lineitem
               JOIN orders ON l_orderkey = o_orderkey),
         m AS (SELECT max(o_orderdate) AS now FROM j)
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate,
           round((epoch_us(now) - epoch_us(l_shipdate)) / 86400e6, 6) AS days_backdated
    FROM j, m WHERE l_shipdate < now - INTERVAL 7 DAY AND o_orderdate >= now - INTERVAL 1 DAY
    ORDER BY days_backdated DESC, l_orderkey * 10000000 + l_partkey LIMIT 100
    """,
)
def d8(spark, d):
    return t.backdated_rows(
        _order_lines(spark, d).withColumn("_key", F.col("l_orderkey") * 10000000 + F.col("l_partkey")),
        "l_shipdate", "o_orderdate", "_key",
    ).drop("_key")


def _order_lines(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")


def _last_order(spark, d):
    return load(spark, d, "orders").agg(F.max("o_orderdate")).first()[0]


@REG.add(
    "d9_future_summary",
    """
    WITH m AS (SELECT max(o_orderdate) AS now FROM orders)
    SELECT count(*) AS future_count, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S.%f') AS furthest_future,
           round(CAST(sum(epoch_us(l_shipdate) - epoch_us(now)) AS DOUBLE) / count(*) / 86400e6, 6) AS avg_days_ahead
    FROM lineitem, m WHERE l_shipdate > now HAVING count(*) > 5
    """,
)
def d9(spark, d):
    return t.future_summary(load(spark, d, "lineitem"), "l_shipdate", _last_order(spark, d))


@REG.add(
    "d10_future_rows",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
    WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders)
    ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100
    """,
)
def d10(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = load(spark, d, "lineitem").select(*key, "l_shipdate")
    return t.future_rows(df, "l_shipdate", _last_order(spark, d), key)


@REG.add(
    "d11_tamper_summary",
    """
    SELECT count(*) AS tampered_count,
           round(CAST(sum(epoch_us(o_orderdate) - epoch_us(l_shipdate)) AS DOUBLE) / count(*) / 3600e6, 6)
               AS avg_hours_diff
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate HAVING count(*) > 0
    """,
)
def d11(spark, d):
    return t.tamper_summary(_order_lines(spark, d), "o_orderdate", "l_shipdate")


@REG.add(
    "d12_tamper_rows",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate LIMIT 100
    """,
)
def d12(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    return t.tamper_rows(_order_lines(spark, d), "o_orderdate", "l_shipdate", key)


def benford_sql(table: str, column: str) -> str:
    expected = ", ".join(f"('{k}', {v})" for k, v in s.BENFORD_PERCENT.items())
    return f"""
    WITH dg AS (
        SELECT left(CAST(abs(CAST({column} AS DECIMAL(20,2))) AS VARCHAR), 1) AS digit, count(*) AS frequency
        FROM {table} WHERE {column} > 0 GROUP BY 1),
    kept AS (SELECT *, CAST(sum(frequency) OVER () AS DOUBLE) AS total FROM dg WHERE digit BETWEEN '1' AND '9'),
    ex(digit, percent) AS (VALUES {expected}),
    chi AS (
        SELECT count(*) AS digits, CAST(coalesce(sum(frequency), 0) AS BIGINT) AS rows_tested,
               round(sum((frequency - CAST(percent AS DOUBLE) * total / 100)
                   * (frequency - CAST(percent AS DOUBLE) * total / 100)
                   / (CAST(percent AS DOUBLE) * total / 100)), 6) AS chi_square
        FROM kept JOIN ex USING (digit))
    """


@REG.add(
    "d13_benford_distribution",
    benford_sql("orders", "o_totalprice")
    + "SELECT digit, frequency, round(frequency * 100.0 / total, 6) AS percentage FROM kept",
)
def d13(spark, d):
    return s.benford_distribution(load(spark, d, "orders"), "o_totalprice")


VERDICT = """
    SELECT *, CAST(CASE WHEN chi_square > 30 THEN 0.001 WHEN chi_square > 20 THEN 0.01 WHEN chi_square > 15.51
           THEN 0.05 ELSE 0.1 END AS DOUBLE) AS p_value,
           CASE WHEN chi_square < 25 THEN 'medium' ELSE 'high' END AS risk_level
    FROM chi WHERE digits >= 7 AND chi_square > 15.51
"""


@REG.add("d14_benford_test", benford_sql("orders", "o_totalprice") + VERDICT)
def d14(spark, d):
    return s.benford_test(load(spark, d, "orders"), "o_totalprice")


@REG.add("d14_benford_test_documents", benford_sql("documents", "n_chars") + VERDICT)
def d14_docs(spark, d):
    return s.benford_test(load(spark, d, "documents"), "n_chars")


def zscore_sql(table: str, column: str) -> str:
    return f"""
    SELECT '{column}' AS column_name, *, round(outlier_count * 100.0 / total_count, 6) AS outlier_percent,
           CASE WHEN outlier_count <= 5 OR outlier_count * 100.0 / total_count <= 1 THEN 'none'
                WHEN outlier_count * 100.0 / total_count < 5 THEN 'medium' ELSE 'high' END AS risk_level
    FROM (SELECT count(*) FILTER (WHERE z > 3) AS outlier_count, round(max(z) FILTER (WHERE z > 3), 6) AS max_z_score,
                 CAST(min(v) FILTER (WHERE z > 3) AS DOUBLE) AS min_value,
                 CAST(max(v) FILTER (WHERE z > 3) AS DOUBLE) AS max_value, count(v) AS total_count
          FROM (SELECT {column} AS v, abs({column} - (SELECT avg({column}) FROM {table}))
                    / nullif((SELECT stddev_samp({column}) FROM {table}), 0) AS z FROM {table}))
    """


@REG.add(
    "d15_zscore_summary",
    zscore_sql("lineitem", "l_extendedprice") + " UNION ALL " + zscore_sql("lineitem", "l_quantity")
    + " UNION ALL " + zscore_sql("events", "value") + " UNION ALL " + zscore_sql("documents", "n_chars"),
)
def d15(spark, d):
    return s.union_all(
        [
            s.zscore_summary(load(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], False),
            s.zscore_summary(load(spark, d, "events"), ["value"], False),
            s.zscore_summary(load(spark, d, "documents"), ["n_chars"], False),
        ]
    )


@REG.add(
    "d16_zscore_rows",
    """
    SELECT * FROM (
        SELECT event_id, user_id, value, round(abs(value - (SELECT avg(value) FROM events))
            / nullif((SELECT stddev_samp(value) FROM events), 0), 6) AS z_score FROM events)
    WHERE z_score > 3 ORDER BY z_score DESC, event_id LIMIT 100
    """,
)
def d16(spark, d):
    df = load(spark, d, "events").select("event_id", "user_id", "value")
    return s.zscore_rows(df, "value", "event_id")


LABELLED = "(SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return docs.join(load(spark, d, "labels"), "doc_id", "left")


@REG.add(
    "d17_audit_gaps",
    f"""
    SELECT count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) AS rows_without_audit, count(*) AS total_rows,
           round(count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) * 100.0 / count(*), 6) AS percentage
    FROM {LABELLED}
    """,
)
def d17(spark, d):
    return g.audit_gaps(_labelled(spark, d), ["quality", "toxic"])


NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {LABELLED}"
    for c in ["doc_id", "quality", "toxic"]
)


@REG.add("d18_critical_nulls", NULLS)
def d18(spark, d):
    return g.critical_nulls(_labelled(spark, d), ["doc_id", "quality", "toxic"])


def orphan_sql(child: str, column: str, parent: str, key: str) -> str:
    return f"""
    SELECT '{child}' AS child_table, '{column}' AS child_column, '{parent}' AS parent_table, count(*) AS orphan_count,
           CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) < 100 THEN 'medium' ELSE 'high' END AS risk_level
    FROM {child} c WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})
    """


@REG.add(
    "d19_orphan_counts",
    " UNION ALL ".join(
        [
            orphan_sql("lineitem", "l_orderkey", "orders", "o_orderkey"),
            orphan_sql("lineitem", "l_partkey", "part", "p_partkey"),
            orphan_sql("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            orphan_sql("documents", "doc_id", "labels", "doc_id"),
        ]
    ),
)
def d19(spark, d):
    lines = g.orphan_counts(
        "lineitem",
        load(spark, d, "lineitem"),
        [
            ("l_orderkey", "orders", load(spark, d, "orders"), "o_orderkey"),
            ("l_partkey", "part", load(spark, d, "part"), "p_partkey"),
            ("l_suppkey", "supplier", load(spark, d, "supplier"), "s_suppkey"),
        ],
    )
    docs = g.orphan_counts(
        "documents", load(spark, d, "documents"), [("doc_id", "labels", load(spark, d, "labels"), "doc_id")]
    )
    return lines.unionByName(docs)


@REG.add(
    "d20_orphan_rows",
    """
    SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    ORDER BY doc_id LIMIT 100
    """,
)
def d20(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "source")
    return g.orphan_rows(docs, load(spark, d, "labels"), "doc_id", "doc_id", "doc_id")


# Every customer points at another one of its block of 50: a permutation with known cycles.
REFERENCES = """
    SELECT c_custkey AS id, (c_custkey // 50) * 50 + (7 * (c_custkey % 50) + 3) % 50 AS ref FROM customer
"""


@REG.add(
    "d21_cycles",
    f"""
    WITH RECURSIVE e AS ({REFERENCES}),
    chain AS (
        SELECT id AS start, ref AS spot, CAST(1 AS BIGINT) AS length, [id] AS path FROM e WHERE ref >= id
        UNION ALL
        SELECT c.start, e.ref, c.length + 1, list_append(c.path, e.id) FROM chain c JOIN e ON e.id = c.spot
        WHERE c.spot > c.start AND c.length < 10 AND NOT list_contains(c.path, e.id) AND e.ref >= c.start)
    SELECT start, length, array_to_string(path, '>') AS path FROM chain WHERE spot = start
    """,
)
def d21(spark, d):
    block = F.floor(F.col("c_custkey") / 50).cast("bigint") * 50
    refs = load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (block + (7 * (F.col("c_custkey") % 50) + 3) % 50).alias("ref")
    )
    return g.cycles(refs, "id", "ref").withColumn("path", F.array_join("path", ">"))


@REG.add(
    "d22_key_violations",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    """,
)
def d22(spark, d):
    return g.key_violations(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@REG.add("d24_permissive_nulls", f"SELECT *, 'medium' AS risk_level FROM ({NULLS}) WHERE null_count > 0")
def d24(spark, d):
    return g.permissive_nulls(_labelled(spark, d), ["doc_id", "quality", "toxic"])
