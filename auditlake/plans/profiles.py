"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions.exprs import count_if, melt
from auditlake.operators import profile as p
from auditlake.operators import quality as q
from auditlake.operators import state as st
from auditlake.plans import Registry
from auditlake.plans.shapes import mean, total
from auditlake.session import materialize
from auditlake.sources.tables import load

REG = Registry()

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PAGES = ["page_id", "url", "html"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
MONEY_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def per_column(template: str, table: str, cols: list[str]) -> str:
    """One SELECT per column, united."""
    return " UNION ALL ".join(template.format(c=c, t=table) for c in cols)


COUNTS = """
    SELECT '{c}' AS column_name, count(*) AS total_count, count(DISTINCT {c}) AS distinct_count,
           count({c}) AS non_null_count, count(*) - count({c}) AS null_count FROM {t}
"""


@REG.add("c1_column_counts", per_column(COUNTS, "lineitem", LINES))
def c1(spark, d):
    return p.column_counts(load(spark, d, "lineitem"))


@REG.add(
    "c2_numeric_range",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
        f"{mean(c)} AS avg_value, CAST(min({c}) AS VARCHAR) AS min_exact, CAST(max({c}) AS VARCHAR) AS max_exact FROM lineitem"
        for c in LINES[:8]
    ),
)
def c2(spark, d):
    return p.numeric_range(load(spark, d, "lineitem"))


@REG.add(
    "c3_temporal_range",
    """
    SELECT 'l_shipdate' AS column_name, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S.%f') AS min_value,
           strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S.%f') AS max_value FROM lineitem
    """,
)
def c3(spark, d):
    return p.temporal_range(load(spark, d, "lineitem"))


SAMPLES = """
    SELECT '{c}' AS column_name, (SELECT string_agg(v, '|' ORDER BY v) FROM (
        SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples
"""


@REG.add("c4_distinct_samples", per_column(SAMPLES, "orders", ORDERS))
def c4(spark, d):
    out = p.distinct_samples(load(spark, d, "orders"), 5)
    return out.selectExpr("column_name", "array_join(sample_values, '|') AS samples")


@REG.add(
    "c4_column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) AS total_count,
            count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count,
            {low} AS min_value, {high} AS max_value, {avg} AS avg_value,
            (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer
             WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples FROM customer"""
        for c, kind in zip(CUSTOMER, ["integer", "text", "integer", "numeric", "text"])
        for low, high, avg in [
            (f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)", mean(c))
            if kind != "text"
            else ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)")
        ]
    ),
)
def c4_profile(spark, d):
    out = p.column_profile(load(spark, d, "customer"))
    return out.withColumn("samples", out.sample_values.cast("array<string>")).selectExpr(
        "column_name", "data_type", "total_count", "distinct_count", "null_count", "min_value", "max_value",
        "avg_value", "array_join(samples, '|') AS samples",
    )


@REG.add(
    "c5_numeric_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
            {mean(c)} AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
            round(stddev_samp({c}), 6) AS std_dev, count(*) - count({c}) AS null_count FROM lineitem"""
        for c in LINES[:8]
    ),
)
def c5(spark, d):
    return p.numeric_summary(load(spark, d, "lineitem"))


CATEGORIES = """
    SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM {t}) AS unique_values,
           (SELECT count(*) - count({c}) FROM {t}) AS null_count,
           row_number() OVER (ORDER BY n DESC, value) AS place, value, n
    FROM (SELECT {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)
    QUALIFY place <= 5
"""


@REG.add("c6_categorical_summary", per_column(CATEGORIES, "orders", ["o_orderstatus", "o_orderpriority"]))
def c6(spark, d):
    return p.categorical_summary(load(spark, d, "orders"), 5)


@REG.add(
    "c7_missing_values",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing
            FROM (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
        for c in ["doc_id", "lang", "quality", "toxic"]
    ),
)
def c7(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return p.missing_values(docs.join(load(spark, d, "labels"), "doc_id", "left"))


@REG.add(
    "c8_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for i, a in enumerate(MONEY_COLUMNS)
        for b in MONEY_COLUMNS[i + 1 :]
    ),
)
def c8(spark, d):
    return p.correlations(load(spark, d, "lineitem"), MONEY_COLUMNS)


def _complete_sql(cols: list[str]) -> str:
    filled = " + ".join(f"count(*) FILTER (WHERE regexp_matches(CAST({c} AS VARCHAR), '\\S'))" for c in cols)
    return f"CAST({filled} AS DOUBLE) / (count(*) * {len(cols)})"


def _consistent_sql(cols: list[str]) -> str:
    parts = " + ".join(
        f"1.0 / (1.0 + CAST(var_samp(length(CAST({c} AS VARCHAR))) AS DOUBLE) / 10.0)" for c in cols
    )
    return f"CAST({parts} AS DOUBLE) / {len(cols)}"


@REG.add(
    "c9_quality_score",
    f"""
    SELECT round(c, 6) AS completeness, round(s, 6) AS consistency, round((c + s) / 2, 6) AS overall
    FROM (SELECT {_complete_sql(CUSTOMER)} AS c, {_consistent_sql(CUSTOMER)} AS s FROM customer)
    """,
)
def c9(spark, d):
    return q.quality_score(load(spark, d, "customer"))


@REG.add(
    "c10_column_ratios",
    per_column(
        """SELECT '{c}' AS column_name, round(CAST(count({c}) AS DOUBLE) / count(*), 6) AS completeness,
           round(CAST(count(DISTINCT {c}) AS DOUBLE) / nullif(count({c}), 0), 6) AS cardinality_ratio FROM {t}""",
        "orders",
        ORDERS,
    ),
)
def c10(spark, d):
    return p.column_ratios(load(spark, d, "orders"))


def _type_share(c: str, kind: str) -> str:
    if kind == "phone":
        bare = f"regexp_replace({c}, '{q.PHONE_SEPARATORS}', '', 'g')"
        hit = f"length({bare}) >= 10 AND length(regexp_replace({bare}, '[^0-9]', '', 'g')) / length({bare}) > 0.7"
    else:
        hit = f"regexp_matches({c}, '{q.TYPE_PATTERNS[kind]}')"
    return f"count(*) FILTER (WHERE {hit}) / count({c})"


def _types_sql(table: str, cols: list[str]) -> str:
    kinds = list(q.TYPE_PATTERNS)
    out = []
    for c in cols:
        shares = ", ".join(f"{_type_share('v', k)} AS s_{k}" for k in kinds)
        best = "greatest(" + ", ".join(f"s_{k}" for k in kinds) + ")"
        names = " ".join(f"WHEN s_{k} = {best} THEN '{k}'" for k in kinds)
        out.append(
            f"""SELECT '{c}' AS column_name, CASE WHEN {best} > 0.7 THEN CASE {names} END ELSE 'string' END
                AS semantic_type, round({best}, 6) AS confidence
                FROM (SELECT {shares} FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {table}))"""
        )
    return " UNION ALL ".join(out)


@REG.add("c11_semantic_types", _types_sql("pages", PAGES))
def c11(spark, d):
    return q.semantic_types(load(spark, d, "pages"))


@REG.add(
    "c12_value_patterns",
    per_column(
        """SELECT '{c}' AS column_name, CASE WHEN min(length(v)) = max(length(v)) THEN 'constant_length'
             WHEN coalesce(bool_and(regexp_matches(v, '[0-9]$')) FILTER (WHERE v <> ''), true) THEN 'numeric_suffix'
             WHEN count(DISTINCT v[1:2]) FILTER (WHERE length(v) >= 2) = 1 THEN 'prefix_pattern'
             WHEN bool_and(regexp_matches(v, '[-_.]')) THEN 'contains_separators' ELSE 'variable' END AS pattern
           FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t})""",
        "pages",
        PAGES,
    )
    + " UNION ALL "
    + per_column(
        """SELECT '{c}' AS column_name, CASE WHEN min(length(v)) = max(length(v)) THEN 'constant_length'
             WHEN coalesce(bool_and(regexp_matches(v, '[0-9]$')) FILTER (WHERE v <> ''), true) THEN 'numeric_suffix'
             WHEN count(DISTINCT v[1:2]) FILTER (WHERE length(v) >= 2) = 1 THEN 'prefix_pattern'
             WHEN bool_and(regexp_matches(v, '[-_.]')) THEN 'contains_separators' ELSE 'variable' END AS pattern
           FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t})""",
        "customer",
        CUSTOMER,
    ),
)
def c12(spark, d):
    return q.value_patterns(load(spark, d, "pages")).unionByName(q.value_patterns(load(spark, d, "customer")))


@REG.add(
    "c13_stability_classes",
    per_column(
        """SELECT '{c}' AS column_name,
             CASE WHEN count(v) = 0 THEN 'empty' WHEN count(DISTINCT v) / count(v) >= 0.95 THEN 'unique'
                  WHEN count(DISTINCT v) / count(v) >= 0.5 THEN 'high'
                  WHEN count(DISTINCT v) / count(v) >= 0.1 THEN 'medium' ELSE 'low' END AS cardinality_class,
             CASE WHEN count(v) / count(*) >= 0.95 THEN 'complete' WHEN count(v) / count(*) >= 0.8
                  THEN 'mostly_complete' WHEN count(v) / count(*) >= 0.5 THEN 'partial' ELSE 'sparse' END AS null_class,
             CASE WHEN count(v) = 0 THEN 'empty' WHEN max(length(v)) = min(length(v)) THEN 'fixed_length'
                  WHEN max(length(v)) - min(length(v)) <= 2 THEN 'similar_length' ELSE 'variable_length' END
             AS length_class
           FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t})""",
        "orders",
        ORDERS,
    ),
)
def c13(spark, d):
    return q.stability_classes(load(spark, d, "orders"))


CONTENT = """
    SELECT '{c}' AS column_name, CASE WHEN count(v) = 0 THEN 'empty'
         WHEN bool_and(regexp_matches(v, '^[0-9]+$')) THEN 'numeric_id' WHEN bool_and(contains(v, '@')) THEN 'email'
         WHEN min(length(v)) > 50 THEN 'long_text' WHEN max(length(v)) < 10 THEN 'short_code'
         ELSE 'general_text' END AS content_class
    FROM (SELECT nullif(CAST({c} AS VARCHAR), '') AS v FROM {t})
"""


@REG.add("c14_content_class", per_column(CONTENT, "pages", PAGES) + " UNION ALL " + per_column(CONTENT, "orders", ORDERS))
def c14(spark, d):
    return q.content_class(load(spark, d, "pages")).unionByName(q.content_class(load(spark, d, "orders")))


@REG.add(
    "c15_freshness",
    """
    SELECT days_old, CASE WHEN days_old < 7 THEN 'fresh' WHEN days_old < 30 THEN 'moderate' ELSE 'stale' END
           AS freshness
    FROM (SELECT date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-20') AS days_old FROM orders)
    """,
)
def c15(spark, d):
    return q.freshness(load(spark, d, "orders"), "o_orderdate", "2001-08-20")


@REG.add(
    "c16_trend",
    f"""
    WITH b AS (SELECT date_trunc('month', o_orderdate) AS bucket, {total('o_totalprice')} AS total
               FROM orders GROUP BY 1),
         n AS (SELECT total, CAST(row_number() OVER (ORDER BY bucket) - 1 AS DOUBLE) AS x FROM b),
         l AS (SELECT count(*) AS buckets, round(regr_slope(total, x), 6) AS slope,
                      round(coalesce(regr_r2(total, x), 0), 6) AS strength FROM n)
    SELECT *, CASE WHEN strength < 0.1 OR slope IS NULL THEN 'stable' WHEN slope > 0 THEN 'increasing'
                   ELSE 'decreasing' END AS direction FROM l
    """,
)
def c16(spark, d):
    return p.trend(load(spark, d, "orders"), "o_orderdate", "o_totalprice")


@REG.add(
    "c17_quality_assessment",
    f"""
    WITH r AS (
        SELECT {_complete_sql(ORDERS)} AS completeness, {_consistent_sql(ORDERS)} AS consistency,
               date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-20') AS days,
               (count(*) FILTER (WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '{q.TYPE_PATTERNS['integer']}'))
                   / count(o_orderkey)
                + count(*) FILTER (WHERE regexp_matches(CAST(o_totalprice AS VARCHAR), '{q.TYPE_PATTERNS['float']}'))
                   / count(o_totalprice)
                + count(*) FILTER (WHERE regexp_matches(CAST(o_orderdate AS VARCHAR), '{q.TYPE_PATTERNS['date']}'))
                   / count(o_orderdate)) / 3 AS validity
        FROM orders),
    s AS (SELECT *, CASE WHEN days < 7 THEN 1.0 WHEN days < 30 THEN 0.5 ELSE 0.0 END AS timeliness FROM r)
    SELECT round(completeness, 6) AS completeness, round(consistency, 6) AS consistency,
           round(CAST(timeliness AS DOUBLE), 6) AS timeliness, round(validity, 6) AS validity,
           round((completeness + consistency + CAST(timeliness AS DOUBLE) + validity) / 4, 6) AS overall FROM s
    """,
)
def c17(spark, d):
    declared = {"o_orderkey": "integer", "o_totalprice": "float", "o_orderdate": "date"}
    return q.quality_assessment(load(spark, d, "orders"), "o_orderdate", declared, "2001-08-20")


@REG.add("c18_approx_profile")
def c18(spark, d):
    return st.approx_profile(load(spark, d, "lineitem"))


def exact_figures_sql(table: str, families: dict[str, str], source: str | None = None) -> str:
    """What a merged profile knows exactly, column by column."""
    parts = []
    for c, family in families.items():
        number, time = family in ("integer", "numeric"), family == "temporal"
        edge = lambda f: (
            f"CAST({f}({c}) AS VARCHAR)" if number else f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S.%f')" if time else "CAST(NULL AS VARCHAR)"
        )
        parts.append(
            f"""SELECT '{c}' AS column_name, '{family}' AS data_type, count(*) AS total_count, count({c}) AS non_null_count,
                count(*) - count({c}) AS null_count, {edge('min')} AS min_value, {edge('max')} AS max_value,
                {mean(c) if number else 'CAST(NULL AS DOUBLE)'} AS avg_value FROM {source or table}"""
        )
    return " UNION ALL ".join(parts)


EXACT = ["column_name", "data_type", "total_count", "non_null_count", "null_count", "min_value", "max_value", "avg_value"]
LINE_FAMILIES = dict(zip(LINES, ["integer"] * 4 + ["numeric"] * 4 + ["text"] * 2 + ["temporal"], strict=True))


@REG.add("c18_exact_figures", exact_figures_sql("lineitem", LINE_FAMILIES))
def c18_exact(spark, d):
    return st.approx_profile(load(spark, d, "lineitem")).select(*EXACT)


@REG.add(
    "c18_sketch_bounds",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, true AS distinct_close, true AS median_close, true AS common_close" for c in LINES),
)
def c18_bounds(spark, d):
    """The sketches against exact figures: distinct values within 5 %, medians within 1 % of the ranks, counts of frequent values within 1/1000 of the rows."""
    lines = load(spark, d, "lineitem")
    # One row per column; the sketches are made once, and what they say goes into one more pass as constants.
    near = materialize(st.approx_profile(lines, ranges=False))
    exact = p.column_counts(lines).select("column_name", "distinct_count")
    aggs, entries = [F.count("*").alias("_rows")], []
    for i, r in enumerate(near.collect()):
        c = r["column_name"]
        family, kind, v = LINE_FAMILIES[c], lines.schema[c].dataType, F.col(c)
        if family == "temporal":
            ranked, middle = v, F.lit(r["approx_median_time"]).cast(kind)
        else:
            ranked, middle = (F.length(c) if family == "text" else v).cast("double"), F.lit(r["approx_median"]).cast("double")
        aggs += [F.avg((ranked < middle).cast("double")).alias(f"_b{i}"), F.avg((ranked > middle).cast("double")).alias(f"_a{i}")]
        close = F.lit(True)
        for j, told in enumerate(r["common_values"] or []):
            same = v == F.lit(told["value"]).cast(kind)
            # -0.0 and 0.0 are equal, but two frequent values.
            same = same & (v.cast("string") == told["value"]) if told["value"] in ("0.0", "-0.0") else same
            aggs.append(count_if(same).alias(f"_n{i}_{j}"))
            close &= F.abs(F.col(f"_n{i}_{j}") - told["n"]) <= r["total_count"] / 1000
        entries.append(F.struct(F.lit(c).alias("column_name"), F.col(f"_b{i}").alias("below"), F.col(f"_a{i}").alias("above"), close.alias("common_close")))
    ranks = melt(lines.agg(*aggs).filter("_rows > 0"), entries)
    off = F.abs(F.col("approx_distinct") - F.col("distinct_count")) / F.col("distinct_count")
    return near.join(exact, "column_name").join(ranks, "column_name").select(
        "column_name", (off <= 0.05).alias("distinct_close"), ((F.col("below") <= 0.51) & (F.col("above") <= 0.51)).alias("median_close"), "common_close",
    )
