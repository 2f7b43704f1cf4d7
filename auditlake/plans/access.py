"""Scan, sample, export and inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions.exprs import total_of, trunc
from auditlake.operators import inventory, sampling
from auditlake.plans import Registry
from auditlake.session import scratch_path
from auditlake.sources import sinks
from auditlake.sources.tables import load

REG = Registry()

INVENTORY_TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                    "region", "embeddings", "pages", "benchmark", "labels", "conversations"]


@REG.add("a1_load", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def a1(spark, d):
    return load(spark, d, "supplier")


@REG.add(
    "a2_sample_rows",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
)
def a2(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return sampling.sample_rows(df, "o_orderkey", 5)


@REG.add(
    "a3_sample_recent",
    "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20",
)
def a3_recent(spark, d):
    df = load(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return sampling.sample(df, 20, "recent", key="event_id", ts="ts")


@REG.add(
    "a3_sample_random",
    """
    SELECT event_id, user_id, event_type FROM events
    ORDER BY md5(concat_ws(':', CAST(event_id AS VARCHAR), '7')), event_id LIMIT 20
    """,
)
def a3_random(spark, d):
    df = load(spark, d, "events").select("event_id", "user_id", "event_type")
    return sampling.sample(df, 20, "random", key="event_id", seed=7)


@REG.add(
    "a3_sample_diverse",
    """
    WITH t AS (
        SELECT event_id, user_id, event_type,
               row_number() OVER (PARTITION BY event_type
                   ORDER BY md5(concat_ws(':', CAST(event_id AS VARCHAR), '7')), event_id) AS turn
        FROM events)
    SELECT event_id, user_id, event_type FROM t ORDER BY turn, event_type, event_id LIMIT 18
    """,
)
def a3_diverse(spark, d):
    df = load(spark, d, "events").select("event_id", "user_id", "event_type")
    return sampling.sample(df, 18, "diverse", key="event_id", stratum="event_type", seed=7)


A4_SQL = """
    SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, o_orderstatus,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n
    FROM orders GROUP BY ALL
"""


def _monthly(spark, d):
    return (
        load(spark, d, "orders")
        .groupBy(trunc("month", "o_orderdate").alias("month"), "o_orderstatus")
        .agg(total_of("o_totalprice").alias("total"), F.count("*").alias("n"))
    )


def _export_and_read(spark, d, fmt):
    df = _monthly(spark, d)
    path = sinks.export(df, scratch_path(spark, f"export-{fmt}"), fmt)
    reader = spark.read.schema(df.schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


@REG.add("a4_export_csv", A4_SQL)
def a4_csv(spark, d):
    return _export_and_read(spark, d, "csv")


@REG.add("a4_export_json", A4_SQL)
def a4_json(spark, d):
    return _export_and_read(spark, d, "json")


def _inventory(spark, d):
    return inventory.table_inventory({t: load(spark, d, t) for t in INVENTORY_TABLES})


_COLUMN_COUNTS = {
    "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5,
    "region": 2, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}
_INVENTORY_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({n} AS BIGINT) AS column_count, count(*) AS row_count FROM {t}"
    for t, n in _COLUMN_COUNTS.items()
)


@REG.add(
    "a5_table_inventory",
    f"""
    SELECT table_name, column_count, row_count,
           CASE WHEN row_count = 0 THEN 'empty' WHEN row_count < 1000 THEN 'small'
                WHEN row_count < 100000 THEN 'medium' WHEN row_count < 10000000 THEN 'large'
                ELSE 'very_large' END AS size_class
    FROM ({_INVENTORY_SQL})
    """,
)
def a5(spark, d):
    return _inventory(spark, d).select("table_name", "column_count", "row_count", "size_class")


@REG.add("a5_table_storage")
def a5_storage(spark, d):
    return _inventory(spark, d)


@REG.add(
    "a6_capacity_report",
    f"""
    SELECT table_name, column_count, row_count, row_count > 10000 AS is_large, column_count > 5 AS is_wide
    FROM ({_INVENTORY_SQL}) WHERE row_count > 10000 OR column_count > 5
    """,
)
def a6(spark, d):
    return inventory.capacity_report(_inventory(spark, d), large=10_000, wide=5).select(
        "table_name", "column_count", "row_count", "is_large", "is_wide"
    )


@REG.add(
    "a7_replace_partition",
    """
    SELECT doc_id, source, lang, CASE WHEN lang = 'en' THEN 2 * n_chars ELSE n_chars END AS n_chars
    FROM documents
    """,
)
def a7(spark, d):
    path = scratch_path(spark, "documents-by-lang")
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    sinks.replace_partition(docs, path, "lang")
    fresh = docs.filter(F.col("lang") == "en").withColumn("n_chars", F.col("n_chars") * 2)
    sinks.replace_partition(fresh, path, "lang")
    return spark.read.schema(docs.schema).parquet(path)
