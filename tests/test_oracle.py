"""Every registered query against its SQL on DuckDB, value for value."""

from __future__ import annotations

import datetime as dt

import pytest

import __spark_entry__ as entry
import oracle
from auditlake.functions.exprs import number_text

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, key):
    assert oracle.compare(QUERIES[key](spark, sf_dir), duck, SQL[key]) == []


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["risk_level"] == "high"


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", ["g15_build_documents", "g21_enriched_profile"])
def test_matches_sql_on_both_zeros(spark, tmp_path, key):
    """Examples of a column that holds -0.0 and 0.0."""
    people = [(i, f"C{i}", i % 3, (-0.0, 0.0, -0.25, 1.5)[i % 4], "X") for i in range(12)]
    spark.createDataFrame(people, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    bought = [(i, i, "O", i + 0.5, dt.datetime(2001, 1, 1 + i), "LOW") for i in range(12)]
    spark.createDataFrame(bought, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = oracle.duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert oracle.compare(QUERIES[key](spark, str(tmp_path)), con, SQL[key]) == []


def _amounts(spark, at, balances, step):
    """Customers with these balances and orders of large amounts, keys ``step`` apart."""
    people = [(i * step, f"C{i}", i % 3, b, "X") for i, b in enumerate(balances)]
    spark.createDataFrame(people, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    bought = [(i * step, i * step, "O", 9_999_998.5 + i, dt.datetime(2001, 1, 1 + i), "LOW") for i in range(4)]
    spark.createDataFrame(bought, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    con = oracle.duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("key", ["c4_column_profile", "g15_build_documents"])
@pytest.mark.parametrize(
    "balances", [(1e7, 12345678.9, 10000000.25, 5.5, -2e7), (0.0005, 0.0001, -0.0009, 0.001, 9999999.75), (123456789012.3456, -1e13, 1e10)]
)
def test_matches_sql_on_large_and_small_amounts(spark, tmp_path, key, balances):
    """Amounts that Spark's cast prints with an exponent."""
    con = _amounts(spark, tmp_path, balances, 1)
    assert oracle.compare(QUERIES[key](spark, str(tmp_path)), con, SQL[key]) == []


@pytest.mark.parametrize("step", [1, 10_000_000])
def test_enriched_profile_matches_sql_on_large_means(spark, tmp_path, step):
    """Amounts and means that Spark's cast prints with an exponent."""
    con = _amounts(spark, tmp_path, (1e7, 12345678.9, 10000000.25, 5.5, 2e9), step)
    assert oracle.compare(QUERIES["g21_enriched_profile"](spark, str(tmp_path)), con, SQL["g21_enriched_profile"]) == []


@pytest.mark.parametrize(
    "kind, more", [("float", []), ("double", [1e15, 1.5e15, 9999999999999998.0, 1e16, -1e16, 1.25e17, 1e100, 1.0000000000000002e-4])]
)
def test_numbers_print_as_in_sql(spark, frame, kind, more):
    values = [0.0, -0.0, 1.5, 1e-3, 9.5e-4, 1e-4, 9.9e-5, -1e-5, 1.25e-7, 1e-20, 1e7, -12345678.0, 1e10, *more]
    df = frame(f"v {kind}", [(v,) for v in values])
    con = oracle.duckdb.connect()
    want = [con.execute(f"SELECT CAST(CAST(CAST(? AS DOUBLE) AS {kind}) AS VARCHAR)", [v]).fetchone()[0] for v in values]
    assert [r[0] for r in df.select(number_text("v", df.schema["v"].dataType)).collect()] == want
