"""Relationship discovery queries."""

from __future__ import annotations

from auditlake.operators import relate as r
from auditlake.operators.inventory import table_inventory
from auditlake.plans import Registry
from auditlake.sources.tables import load

REG = Registry()

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "documents": "doc_id",
}
CHILDREN = ["lineitem", "labels", "events"]
#: Columns that look like references, per table: by their names, as the operator sees them.
REFERENCES = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "documents": ["doc_id"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "labels": ["doc_id"], "events": ["event_id", "user_id"],
}
COLUMN_COUNTS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "documents": 5, "lineitem": 11,
    "labels": 3, "events": 6,
}


def tables(spark, d):
    return {name: load(spark, d, name) for name in [*KEYS, *CHILDREN]}


def discovered_sql(references: dict[str, list[str]], keys: dict[str, str], sources: dict[str, str] | None = None) -> str:
    """Links by the names of columns, keys and tables, each checked against all values; the pairs are made in SQL."""
    sources = sources or {}
    values = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {sources.get(t, t)}" for t, cols in references.items() for c in cols
    )
    named = ", ".join(f"('{t}', '{c}')" for t, cols in references.items() for c in cols)
    stated = ", ".join(f"('{t}', '{k}')" for t, k in keys.items())
    bare = lambda c: f"regexp_replace(lower({c}), '^[a-z]{{1,2}}_', '')"
    table = "regexp_replace(a.c, '_id$', '')"
    return f"""
    SELECT source_table, source_column, target_table, target_column, confidence, child_values, matched_values,
           round(matched_values / child_values, 6) AS inclusion_ratio, coalesce(matched_values = child_values, false) AS verified
    FROM (
      WITH v AS ({values}),
           k AS (SELECT * FROM (VALUES {stated}) x(t, c)),
           a AS (SELECT * FROM (VALUES {named}) x(t, c) WHERE (t, c) NOT IN (SELECT t, c FROM k)),
           p AS (SELECT a.t, a.c, k.t AS parent, k.c AS key FROM a LEFT JOIN k ON k.t <> a.t AND (
                   {bare('a.c')} = {bare('k.c')}
                   OR (ends_with(a.c, '_id') AND {table} IN (lower(k.t), rtrim(lower(k.t), 's'), lower(k.t) || 's'))))
      SELECT p.t AS source_table, p.c AS source_column, p.parent AS target_table, p.key AS target_column,
             CASE WHEN parent IS NOT NULL THEN CAST(0.8 AS DOUBLE) END AS confidence,
             CASE WHEN parent IS NOT NULL THEN count(child.v) END AS child_values,
             CASE WHEN parent IS NOT NULL THEN count(known.v) END AS matched_values
      FROM p LEFT JOIN v child ON child.t = p.t AND child.c = p.c
             LEFT JOIN v known ON known.t = p.parent AND known.c = p.key AND known.v = child.v
      GROUP BY p.t, p.c, p.parent, p.key)
    """


DISCOVERED = discovered_sql(REFERENCES, KEYS)


@REG.add("e1_discover_relationships", DISCOVERED)
def e1(spark, d):
    return r.discover_relationships(tables(spark, d), KEYS)


@REG.add(
    "e2_inclusion",
    """
    SELECT count(*) AS child_values, count(*) FILTER (WHERE v IN (SELECT doc_id FROM labels)) AS matched_values,
           round(count(*) FILTER (WHERE v IN (SELECT doc_id FROM labels)) / count(*), 6) AS inclusion_ratio
    FROM (SELECT DISTINCT doc_id AS v FROM documents)
    """,
)
def e2(spark, d):
    return r.inclusion(load(spark, d, "documents"), "doc_id", load(spark, d, "labels"), "doc_id")


@REG.add(
    "e3_cardinality",
    """
    SELECT *, concat(CASE WHEN left_max > 1 THEN 'many' ELSE '1' END, ':',
                     CASE WHEN right_max > 1 THEN 'many' ELSE '1' END) AS cardinality
    FROM (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS left_max,
                 (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)) AS right_max)
    """,
)
def e3(spark, d):
    return r.cardinality(load(spark, d, "lineitem"), "l_orderkey", load(spark, d, "orders"), "o_orderkey")


@REG.add(
    "e4_join_selectivity",
    """
    SELECT count(*) AS matches, round(count(*) / (CAST((SELECT count(*) FROM lineitem) AS DOUBLE)
           * (SELECT count(*) FROM orders)), 12) AS selectivity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    rounded=False,
)
def e4(spark, d):
    return r.join_selectivity(load(spark, d, "lineitem"), "l_orderkey", load(spark, d, "orders"), "o_orderkey")


STRENGTH = f"""
    SELECT table_name, CAST(count(source_table) AS BIGINT) AS links,
           CASE WHEN count(source_table) > 2 THEN 'high' WHEN count(source_table) > 0 THEN 'medium' ELSE 'low' END
               AS strength
    FROM (VALUES {", ".join(f"('{t}')" for t in COLUMN_COUNTS)}) t(table_name)
    LEFT JOIN (SELECT source_table FROM ({DISCOVERED}) WHERE verified) ON source_table = table_name GROUP BY 1
"""


@REG.add("e5_link_strength", STRENGTH)
def e5_strength(spark, d):
    named = tables(spark, d)
    return r.link_strength(table_inventory(named), r.discover_relationships(named, KEYS))


_UNIQUE = {**KEYS, "lineitem": "l_orderkey, l_linenumber", "labels": "doc_id", "events": "event_id"}


@REG.add(
    "e5_schema_coverage",
    f"""
    WITH c AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {n})" for t, n in COLUMN_COUNTS.items())})
                   t(table_name, column_count)),
         k AS ({" UNION ALL ".join(
             f"SELECT '{t}' AS table_name, NOT EXISTS (SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1) AS ok"
             for t, k in _UNIQUE.items())}),
         l AS ({STRENGTH}),
         s AS (SELECT count(*) AS tables, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS key_coverage,
                      round(avg(CASE WHEN links > 0 THEN 1.0 ELSE 0.0 END), 6) AS fk_coverage,
                      round(avg(column_count), 6) AS avg_columns, round(avg(links), 6) AS links_per_table
               FROM c JOIN k USING (table_name) JOIN l USING (table_name))
    SELECT *, CASE WHEN links_per_table > 1.5 THEN 'high' WHEN links_per_table > 0.5 THEN 'medium' ELSE 'low' END
           AS density FROM s
    """,
)
def e5(spark, d):
    named = tables(spark, d)
    unique = {t: k.split(", ") for t, k in _UNIQUE.items()}
    return r.schema_coverage(
        table_inventory(named), r.unique_keys(named, unique), r.discover_relationships(named, KEYS)
    )
