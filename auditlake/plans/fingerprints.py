"""Fingerprint and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import fingerprint as fp
from auditlake.operators import state as st
from auditlake.plans import Registry
from auditlake.plans.profiles import CONTENT, CUSTOMER, EXACT, ORDERS, PAGES, exact_figures_sql
from auditlake.session import materialize, scratch_path
from auditlake.sources.sinks import replace_partition
from auditlake.sources.tables import load

REG = Registry()

FAMILIES = {
    "orders": dict(zip(ORDERS, ["integer", "integer", "text", "numeric", "temporal", "text"])),
    "customer": dict(zip(CUSTOMER, ["integer", "text", "integer", "numeric", "text"])),
    "pages": dict(zip(PAGES, ["integer", "text", "text"])),
}
CLASSES = """
    SELECT '{c}' AS column_name, '{family}' AS type_family,
         CASE WHEN count(v) = 0 THEN 'empty' WHEN count(DISTINCT v) / count(v) >= 0.95 THEN 'unique'
              WHEN count(DISTINCT v) / count(v) >= 0.5 THEN 'high'
              WHEN count(DISTINCT v) / count(v) >= 0.1 THEN 'medium' ELSE 'low' END AS cardinality_class,
         CASE WHEN count(v) / count(*) >= 0.95 THEN 'complete' WHEN count(v) / count(*) >= 0.8
              THEN 'mostly_complete' WHEN count(v) / count(*) >= 0.5 THEN 'partial' ELSE 'sparse' END AS null_class,
         CASE WHEN count(v) = 0 THEN 'empty' WHEN max(length(v)) = min(length(v)) THEN 'fixed_length'
              WHEN max(length(v)) - min(length(v)) <= 2 THEN 'similar_length' ELSE 'variable_length' END AS length_class,
         ({content}) AS content_class
    FROM (SELECT CAST({expr} AS VARCHAR) AS v FROM {t})
"""


def components_sql(table: str, families: dict[str, str], source: str | None = None) -> str:
    source = source or table
    parts = []
    for c, family in families.items():
        content = f"SELECT content_class FROM ({CONTENT.format(c=c, t=source)})"
        parts.append(CLASSES.format(c=c, family=family, content=content, expr=c, t=source))
    return " UNION ALL ".join(parts)


SIZE = (
    "CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 1000 THEN 'small' WHEN count(*) < 100000 THEN 'medium' "
    "WHEN count(*) < 10000000 THEN 'large' ELSE 'very_large' END"
)


def fingerprint_sql(table: str, families: dict[str, str], source: str | None = None) -> str:
    return f"""
    SELECT '{table}' AS table_name, left(sha256(concat_ws(chr(10), '{table}',
        string_agg(concat_ws('|', column_name, type_family, cardinality_class, null_class, length_class, content_class),
                   chr(10) ORDER BY column_name), '', (SELECT {SIZE} FROM {source or table}))), 16) AS fingerprint
    FROM ({components_sql(table, families, source)})
    """


PRINTS = " UNION ALL ".join(fingerprint_sql(t, fam) for t, fam in FAMILIES.items())


@REG.add("f1_table_fingerprint", PRINTS)
def f1(spark, d):
    return fp.fingerprints({t: load(spark, d, t) for t in FAMILIES})


def row_md5(cols):
    return "md5(concat(" + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols) + "))"


@REG.add(
    "f2_content_fingerprint",
    f"""
    SELECT count(*) AS row_count, 
           CAST(sum(CAST('0x' || left({row_md5(ORDERS)}, 16) AS UBIGINT)) AS VARCHAR) || ':' ||
           CAST(sum(CAST('0x' || right({row_md5(ORDERS)}, 16) AS UBIGINT)) AS VARCHAR) AS hash_sum
    FROM orders
    """,
)
def f2(spark, d):
    return fp.content_fingerprint(load(spark, d, "orders"))


OLD = f"SELECT o_orderkey, {row_md5(ORDERS)} AS h FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'"
NEW = f"""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN md5('x') ELSE
           {row_md5(ORDERS)} END AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01'
"""
CHANGES = f"""
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
           CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
                WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status
    FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.o_orderkey = b.o_orderkey
"""


def _changes(spark, d):
    orders = load(spark, d, "orders").withColumn("h", fp.row_hash(ORDERS))
    old = orders.filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    touched = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    new = orders.filter(F.col("o_orderdate") >= F.lit("1995-03-01").cast("timestamp_ntz")).withColumn(
        "h", F.when(touched, F.md5(F.lit("x"))).otherwise(F.col("h"))
    )
    return fp.snapshot_changes(old, new, "o_orderkey", "h")


@REG.add("f3_snapshot_changes", CHANGES)
def f3_rows(spark, d):
    return _changes(spark, d)


@REG.add(
    "f3_snapshot_diff",
    f"""
    WITH s AS (SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed')
                   AS removed, count(*) FILTER (WHERE status = 'changed') AS changed,
                   count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM ({CHANGES})),
         r AS (SELECT *, (added + removed + changed) / greatest(added + changed + unchanged, 1) AS share FROM s)
    SELECT added, removed, changed, unchanged, round(share, 6) AS change_ratio,
           CASE WHEN added + removed + changed = 0 THEN 'no_change' WHEN share < 0.3 THEN 'incremental' ELSE 'major' END
               AS change_type, share >= 0.5 AS full_rerun FROM r
    """,
)
def f3(spark, d):
    return fp.snapshot_diff(_changes(spark, d))


NEW_CUSTOMER = (
    "(SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"
)
NEW_FAMILIES = {**FAMILIES["customer"], "c_nationkey": "text"}


def _new_customer(spark, d):
    return load(spark, d, "customer").withColumns(
        {
            "c_nationkey": F.col("c_nationkey").cast("string"),
            "c_acctbal": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")),
        }
    )


@REG.add(
    "f4_component_diff",
    f"""
    WITH a AS ({components_sql("customer", FAMILIES["customer"])}),
         b AS ({components_sql("customer", NEW_FAMILIES, NEW_CUSTOMER)}),
         d AS (SELECT bool_or(a.type_family IS DISTINCT FROM b.type_family) AS structural_changed,
                      bool_or(a.cardinality_class IS DISTINCT FROM b.cardinality_class
                           OR a.null_class IS DISTINCT FROM b.null_class
                           OR a.length_class IS DISTINCT FROM b.length_class
                           OR a.content_class IS DISTINCT FROM b.content_class) AS data_patterns_changed
               FROM a FULL JOIN b ON a.column_name = b.column_name),
         m AS (SELECT d.*, (SELECT {SIZE} FROM customer) <> (SELECT {SIZE} FROM {NEW_CUSTOMER}) AS metadata_changed
               FROM d)
    SELECT 'customer' AS table_name, structural_changed OR data_patterns_changed OR metadata_changed AS table_changed,
           structural_changed, data_patterns_changed, metadata_changed,
           CASE WHEN structural_changed THEN 'high'
                WHEN data_patterns_changed OR metadata_changed THEN 'low' ELSE 'none' END AS impact
    FROM m
    """,
)
def f4(spark, d):
    return fp.component_diff("customer", load(spark, d, "customer"), _new_customer(spark, d))


NEW_PRINTS = (
    fingerprint_sql("orders", FAMILIES["orders"])
    + " UNION ALL "
    + fingerprint_sql("customer", NEW_FAMILIES, NEW_CUSTOMER)
)


@REG.add(
    "f5_recompute_plan",
    f"""
    WITH c AS (
        SELECT coalesce(a.table_name, b.table_name) AS table_name,
               CASE WHEN a.table_name IS NULL THEN 'added' WHEN b.table_name IS NULL THEN 'removed'
                    WHEN a.fingerprint = b.fingerprint THEN 'unchanged' ELSE 'changed' END AS status
        FROM ({PRINTS}) a FULL JOIN ({NEW_PRINTS}) b ON a.table_name = b.table_name),
    s AS (SELECT count(*) FILTER (WHERE status <> 'unchanged') / greatest(count(*) FILTER (WHERE status <> 'removed'), 1)
              AS share FROM c)
    SELECT table_name, status, concat(CASE WHEN share >= 0.5 THEN 'major_changes_' ELSE 'incremental_changes_' END,
               CASE WHEN share < 0.3 THEN 'incremental' ELSE 'major' END) AS reason
    FROM c, s WHERE status IN ('added', 'changed') OR (share >= 0.5 AND status = 'removed')
    """,
)
def f5(spark, d):
    old = fp.fingerprints({t: load(spark, d, t) for t in FAMILIES})
    new = fp.fingerprints({"orders": load(spark, d, "orders"), "customer": _new_customer(spark, d)})
    # One row per table, read twice by the plan: compute it once.
    return fp.recompute_plan(materialize(fp.snapshot_changes(old, new, "table_name", "fingerprint")))


# Key and links per table, as a caller states them.
STATED_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "pages": ["page_id"]}
STATED_LINKS = {"orders": ["o_custkey->customer.c_custkey"], "customer": ["c_nationkey->nation.n_nationkey"]}


def _leaves_sql(families: dict[str, dict[str, str]], keys, links, sources: dict[str, str] | None = None) -> str:
    parts = []
    for t, columns in families.items():
        source = (sources or {}).get(t, t)
        body = components_sql(t, columns, source)
        parts += [
            f"SELECT '{t}' AS table_name, 'structural' AS component, column_name AS part, type_family AS value FROM ({body})",
            f"""SELECT '{t}', 'data_patterns', column_name, concat_ws('|', cardinality_class, null_class, length_class, content_class)
                FROM ({body})""",
            f"SELECT '{t}', 'metadata', 'size', {SIZE} FROM {source}",
            f"SELECT '{t}', 'relational', 'key', '{','.join(sorted(keys.get(t, [])))}'",
            *[f"SELECT '{t}', 'relational', 'link', '{x}'" for x in sorted(links.get(t, []))],
        ]
    return " UNION ALL ".join(parts)


def tree_sql(leaves: str) -> str:
    short = lambda x: f"left(sha256({x}), 16)"
    over = "string_agg(fingerprint, chr(10) ORDER BY fingerprint)"
    return f"""
    WITH l AS (SELECT *, {short("concat_ws('=', component, part, value)")} AS fingerprint FROM ({leaves})),
         c AS (SELECT table_name, component, {short(over)} AS fingerprint FROM l GROUP BY ALL),
         t AS (SELECT table_name, {short(f"concat_ws(chr(10), table_name, {short(over)})")} AS fingerprint FROM c GROUP BY table_name)
    SELECT 'schema' AS level, CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS VARCHAR) AS part,
           {short(f"concat_ws(chr(10), CAST(count(*) AS VARCHAR), {over})")} AS fingerprint FROM t
    UNION ALL SELECT 'table', table_name, NULL, NULL, fingerprint FROM t
    UNION ALL SELECT 'component', table_name, component, NULL, fingerprint FROM c
    UNION ALL SELECT 'leaf', table_name, component, part, fingerprint FROM l
    """


@REG.add("f1_schema_fingerprint", tree_sql(_leaves_sql(FAMILIES, STATED_KEYS, STATED_LINKS)))
def f1_schema(spark, d):
    return fp.fingerprint_tree({t: load(spark, d, t) for t in FAMILIES}, STATED_KEYS, STATED_LINKS)


# Orders lose a link, customers change as above, pages go, and regions come.
LATER_FAMILIES = {"orders": FAMILIES["orders"], "customer": NEW_FAMILIES, "region": {"r_regionkey": "integer", "r_name": "text"}}


@REG.add(
    "f4_tree_diff",
    f"""
    WITH old AS ({_leaves_sql(FAMILIES, STATED_KEYS, STATED_LINKS)}),
         new AS ({_leaves_sql(LATER_FAMILIES, STATED_KEYS, {"customer": STATED_LINKS["customer"]}, {"customer": NEW_CUSTOMER})}),
         d AS ((SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL (SELECT * FROM new EXCEPT ALL SELECT * FROM old))
    SELECT table_name, CASE WHEN table_name NOT IN (SELECT table_name FROM old) THEN 'added'
                            WHEN table_name NOT IN (SELECT table_name FROM new) THEN 'removed' ELSE 'changed' END AS status,
           bool_or(component = 'structural') AS structural_changed, bool_or(component = 'relational') AS relational_changed,
           bool_or(component = 'data_patterns') AS data_patterns_changed, bool_or(component = 'metadata') AS metadata_changed,
           CASE WHEN bool_or(component IN ('structural', 'relational')) THEN 'high' ELSE 'low' END AS impact,
           string_agg(DISTINCT component || '.' || part, ',' ORDER BY component || '.' || part) AS changed_parts
    FROM d GROUP BY table_name
    """,
)
def f4_tree(spark, d):
    old = fp.fingerprint_tree({t: load(spark, d, t) for t in FAMILIES}, STATED_KEYS, STATED_LINKS)
    later = {"orders": load(spark, d, "orders"), "customer": _new_customer(spark, d), "region": load(spark, d, "region")}
    new = fp.fingerprint_tree(later, STATED_KEYS, {"customer": STATED_LINKS["customer"]})
    return fp.tree_diff(old, new).withColumn("changed_parts", F.array_join("changed_parts", ","))


# The orders in progress are ingested anew, their totals raised by one and their urgent ones left out.
INGESTED = """(SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders
    WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'))"""


@REG.add("f5_reprofile", exact_figures_sql("orders", FAMILIES["orders"], INGESTED))
def f5_reprofile(spark, d):
    """A table of files by status, its states, an ingest of one status, and the profile from old and new states."""
    path = scratch_path(spark, "orders")
    orders = load(spark, d, "orders")
    replace_partition(orders, path, "o_orderstatus")
    before = materialize(st.refresh(spark, path))
    part = orders.filter("o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    replace_partition(part, path, "o_orderstatus")
    after = st.refresh(spark, path, before)
    return st.reprofile(spark, path, after).select(*EXACT)
