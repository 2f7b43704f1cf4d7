"""Read-only query shapes over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import query as q
from auditlake.plans import Registry
from auditlake.sources.tables import load

REG = Registry()

MONEY = "CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE)"
# Rounded as a decimal of the printed value, the way Spark rounds a double.
MEAN = (
    "CAST(round(CAST(CAST(CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / count({c}) AS VARCHAR)"
    " AS DECIMAL(38,20)), 6) AS DOUBLE)"
)


def total(c: str) -> str:
    return MONEY.format(c=c)


def mean(c: str) -> str:
    return MEAN.format(c=c)


@REG.add(
    "b1_select_where",
    """
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'
    ORDER BY c_custkey LIMIT 100
    """,
)
def b1(spark, d):
    df = load(spark, d, "customer")
    return q.select_where(
        df, ["c_custkey", "c_name", "c_acctbal"], F.col("c_mktsegment") == "BUILDING", 100, "c_custkey"
    )


@REG.add("b2_count_rows", "SELECT count(*) AS row_count FROM lineitem")
def b2(spark, d):
    return q.count_rows(load(spark, d, "lineitem"))


@REG.add(
    "b3_top_k",
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
)
def b3(spark, d):
    df = load(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return q.top_k(df, "p_retailprice", 10, "p_partkey")


@REG.add("b4_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def b4(spark, d):
    return q.group_count(load(spark, d, "orders"), "o_orderstatus")


@REG.add(
    "b5_filtered_group_agg",
    f"""
    SELECT c_nationkey, count(*) AS n, {mean('c_acctbal')} AS avg_value
    FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1
    """,
)
def b5(spark, d):
    df = load(spark, d, "customer")
    return q.filtered_group_agg(df, F.col("c_mktsegment") == "MACHINERY", "c_nationkey", "c_acctbal")


@REG.add(
    "b6_monthly_sum",
    f"""
    SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, {total('o_totalprice')} AS total
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 1
    """,
)
def b6(spark, d):
    return q.monthly_sum(load(spark, d, "orders"), "o_orderdate", "o_totalprice", F.col("o_orderstatus") == "F")


@REG.add(
    "b7_join_agg",
    f"""
    SELECT p_brand, count(*) AS n, {total('l_extendedprice')} AS total, {mean('l_extendedprice')} AS avg_value
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    """,
)
def b7(spark, d):
    return q.join_agg(
        load(spark, d, "lineitem"), load(spark, d, "part"), "l_partkey", "p_partkey", "p_brand", "l_extendedprice"
    )


@REG.add(
    "b8_where_lt",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem
    WHERE l_suppkey < l_quantity
    """,
)
def b8(spark, d):
    df = load(spark, d, "lineitem")
    return q.where_lt(df, "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


@REG.add("b9_group_avg", f"SELECT p_type, {mean('p_retailprice')} AS avg_value FROM part GROUP BY 1")
def b9(spark, d):
    return q.group_avg(load(spark, d, "part"), "p_type", "p_retailprice")


@REG.add(
    "b10_semi_in",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
    """,
)
def b10(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rich = load(spark, d, "customer").filter(F.col("c_acctbal") > 9000)
    return q.semi_in(orders, rich, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@REG.add(
    "b11_row_numbers",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS row_num
    FROM orders
    """,
)
def b11(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return q.row_numbers(df, "o_orderstatus", "o_totalprice", "o_orderkey")


@REG.add(
    "b12_top_k_per_group",
    f"""
    WITH t AS (
        SELECT c_custkey, c_nationkey, {total('o_totalprice')} AS total
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT * FROM (
        SELECT c_custkey, total, c_nationkey,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS place FROM t)
    WHERE place <= 10
    """,
)
def b12(spark, d):
    return q.top_k_per_group(
        load(spark, d, "orders"), load(spark, d, "customer"), "o_custkey", "c_custkey", "c_nationkey",
        "o_totalprice", 10,
    )


@REG.add(
    "b13_kpis",
    f"""
    SELECT (SELECT CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)
            FROM lineitem) AS total_revenue,
           (SELECT {mean('o_totalprice')} FROM orders) AS avg_order_value,
           (SELECT count(*) FROM orders) AS order_count,
           (SELECT round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)
                   / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 6) FROM lineitem) AS margin
    """,
)
def b13(spark, d):
    return q.kpis(load(spark, d, "orders"), load(spark, d, "lineitem"), "l_extendedprice", "l_discount", "o_totalprice")


@REG.add("b14_scalar_avg", f"SELECT {mean('l_quantity')} AS value FROM lineitem")
def b14_avg(spark, d):
    return q.scalar_agg(load(spark, d, "lineitem"), "avg", "l_quantity")


@REG.add("b14_scalar_sum", f"SELECT {total('o_totalprice')} AS value FROM orders")
def b14_sum(spark, d):
    return q.scalar_agg(load(spark, d, "orders"), "sum", "o_totalprice")


@REG.add(
    "b15_cohort_compare",
    f"""
    SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS in_cohort, count(*) AS n,
           {mean('o_totalprice')} AS avg_value, {total('o_totalprice')} AS total
    FROM orders GROUP BY 1
    """,
)
def b15(spark, d):
    flag = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return q.cohort_compare(load(spark, d, "orders"), flag, "o_totalprice")


@REG.add(
    "b16_inactive_since",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (
        SELECT o_custkey FROM orders
        WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY)
    """,
)
def b16(spark, d):
    return q.inactive_since(
        load(spark, d, "customer"), load(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderdate", 365
    ).select("c_custkey", "c_name")


@REG.add(
    "b17_count_between",
    """
    SELECT count(*) AS row_count FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
    """,
)
def b17(spark, d):
    return q.count_between(load(spark, d, "orders"), "o_orderdate", "1997-01-01", "1998-01-01")


@REG.add(
    "b18_search_sort_page",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    WHERE lower(CAST(c_custkey AS VARCHAR)) LIKE '%build%' OR lower(c_name) LIKE '%build%'
       OR lower(CAST(c_nationkey AS VARCHAR)) LIKE '%build%' OR lower(CAST(c_acctbal AS VARCHAR)) LIKE '%build%'
       OR lower(c_mktsegment) LIKE '%build%'
    ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 25
    """,
)
def b18(spark, d):
    return q.search_sort_page(load(spark, d, "customer"), "Build", "c_acctbal", False, 2, 25, "c_custkey")


@REG.add(
    "b19_capped",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1000",
)
def b19(spark, d):
    df = load(spark, d, "orders").filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")
    return q.capped(df, order_by=["o_orderkey"])
