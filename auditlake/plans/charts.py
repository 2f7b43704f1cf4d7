"""Chart-ready queries."""

from __future__ import annotations

from auditlake.operators import charts as c
from auditlake.plans import Registry
from auditlake.plans.shapes import total
from auditlake.sources.tables import load

REG = Registry()


@REG.add(
    "i1_series_matrix",
    "SELECT o_orderpriority, "
    + ", ".join(
        f"coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE o_orderstatus = '{s}') AS DOUBLE), 0) "
        f'AS "{s}"'
        for s in "FOP"
    )
    + " FROM orders GROUP BY 1",
)
def i1(spark, d):
    return c.series_matrix(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@REG.add(
    "i2_shares",
    f"""
    SELECT o_orderstatus, {total('o_totalprice')} AS total,
           round({total('o_totalprice')} * 100 / (SELECT {total('o_totalprice')} FROM orders), 6) AS share
    FROM orders GROUP BY 1
    """,
)
def i2(spark, d):
    return c.shares(load(spark, d, "orders"), "o_orderstatus", "o_totalprice")


@REG.add(
    "i3_histogram",
    """
    WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
         b AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 19) AS BIGINT) AS bin, count(*) AS n
               FROM orders, s GROUP BY 1)
    SELECT r.bin, round(lo + w * r.bin, 6) AS low, round(lo + w * (r.bin + 1), 6) AS high, coalesce(n, 0) AS n
    FROM (SELECT range AS bin FROM range(20)) r CROSS JOIN s LEFT JOIN b ON r.bin = b.bin
    """,
)
def i3(spark, d):
    return c.histogram(load(spark, d, "orders"), "o_totalprice", 20)


@REG.add("i4_heatmap", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def i4(spark, d):
    return c.heatmap(load(spark, d, "lineitem"), "l_returnflag", "l_linenumber")


@REG.add(
    "i5_box",
    """
    SELECT l_returnflag, min(l_extendedprice) AS min_value, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3,
           max(l_extendedprice) AS max_value
    FROM lineitem GROUP BY 1
    """,
)
def i5(spark, d):
    return c.box(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@REG.add(
    "i6_hierarchy",
    f"""
    SELECT p_type, p_brand, {total('p_retailprice')} AS total, count(*) AS n,
           CAST(2 - (CASE grouping_id(p_type, p_brand) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS BIGINT) AS depth
    FROM part GROUP BY ROLLUP (p_type, p_brand)
    """,
)
def i6(spark, d):
    return c.hierarchy(load(spark, d, "part"), ["p_type", "p_brand"], "p_retailprice")


@REG.add(
    "i7_flows",
    """
    SELECT event_type AS from_state, nxt AS to_state, count(*) AS n FROM (
        SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    WHERE nxt IS NOT NULL GROUP BY 1, 2
    """,
)
def i7(spark, d):
    return c.flows(load(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


@REG.add(
    "i8_funnel",
    """
    WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
         b AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN a USING (user_id)
               WHERE event_type = 'click' AND e.ts > a.t GROUP BY 1),
         c AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN b USING (user_id)
               WHERE event_type = 'purchase' AND e.ts > b.t GROUP BY 1),
         s AS (SELECT CAST(1 AS BIGINT) AS step, 'view' AS state, count(*) AS entities FROM a
               UNION ALL SELECT 2, 'click', count(*) FROM b UNION ALL SELECT 3, 'purchase', count(*) FROM c)
    SELECT *, round(entities / first_value(entities) OVER (ORDER BY step), 6) AS share FROM s
    """,
)
def i8(spark, d):
    return c.funnel(load(spark, d, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"])
