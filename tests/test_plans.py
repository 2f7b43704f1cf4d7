"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditlake.operators.findings import Roles, findings
from auditlake.plans import profiles

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "key",
    ["b10_semi_in", "b16_inactive_since", "d15_zscore_summary", "d19_orphan_counts", "e1_discover_relationships",
     "g3_knn_join", "g4_ann_join", "g13_match_names", "g18_mentions", "h3_top_share", "i8_funnel"],
)
def test_no_cross_join(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("key", ["a3_sample_diverse", "b12_top_k_per_group", "c6_categorical_summary", "h10_keep_last_per_user"])
def test_group_limit_runs_before_the_shuffle(spark, sf_dir, key):
    assert "WindowGroupLimit" in plan(QUERIES[key](spark, sf_dir))


@pytest.mark.parametrize(
    "key,column", [("b17_count_between", "o_orderdate"), ("d4_velocity", "ts"), ("d7_backdated_summary", "o_orderdate"),
                   ("d10_future_rows", "l_shipdate"), ("h16_expired_count", "ts")]
)
def test_time_filters_reach_the_scan(spark, sf_dir, key, column):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan(QUERIES[key](spark, sf_dir)))
    assert any(f"({column}," in p for p in pushed)


@pytest.mark.parametrize(
    "key,columns", [("d14_benford_test", {"o_totalprice"}), ("b9_group_avg", {"p_type", "p_retailprice"}),
                    ("d1_duplicates", {"l_quantity", "l_shipdate"}), ("h2_daily_usage", {"ts", "user_id"})]
)
def test_only_needed_columns_are_read(spark, sf_dir, key, columns):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[key](spark, sf_dir))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.mark.parametrize("key", ["b3_top_k", "d6b_off_hours", "d16_zscore_rows", "h10_keep_last"])
def test_top_k_does_not_sort_everything(spark, sf_dir, key):
    assert "TakeOrderedAndProject" in plan(QUERIES[key](spark, sf_dir))


def scans(df) -> int:
    return len(re.findall(r"(?m)^.*Scan parquet", df._jdf.queryExecution().executedPlan().toString()))


def test_each_table_is_read_once_for_all_its_links(spark, sf_dir):
    df = QUERIES["e1_discover_relationships"](spark, sf_dir)
    assert scans(df) == len({"region", "nation", "customer", "supplier", "part", "orders", "documents", "lineitem", "labels"})
    # Three references of one table and one of another, with their parents.
    assert scans(QUERIES["d19_orphan_counts"](spark, sf_dir)) == 6


def test_findings_read_a_table_once_for_all_row_verdicts(spark, sf_dir):
    """The first look is a job of its own; here are the verdicts: one scan, one a group verdict, one for all references."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    roles = Roles(
        lines, amount="l_extendedprice", ts="l_shipdate", measures=["l_quantity", "l_tax", "l_discount"], audit=["l_tax"], critical=["l_tax"],
        fks=[("l_partkey", "part", parts, "p_partkey"), ("l_suppkey", "part", parts, "p_partkey")], duplicate_of=["l_quantity", "l_shipdate"],
    )
    assert scans(findings({"lineitem": roles})) == 1 + 1 + 2


def test_sketches_are_made_once_for_their_bounds(spark, sf_dir):
    """What is checked of them takes a pass with constants: no sketch, no value of a row in an array, is left in the plan."""
    text = plan(QUERIES["c18_sketch_bounds"](spark, sf_dir))
    assert "approx_top_k" not in text and "kll_sketch" not in text
    assert len(re.findall(r"(?m)^.*Scan parquet", text)) <= 5


def test_bounds_tell_when_sketches_are_off(spark, sf_dir, monkeypatch):
    """Each figure wrong in turn: its own column of the result says so, for every column that has one."""
    real = profiles.st.approx_profile
    wrong = {
        "distinct_close": {"approx_distinct": F.col("approx_distinct") * 2},
        "median_close": {"approx_median": F.col("approx_median") + 1e9, "approx_median_time": F.lit("1970-01-01 00:00:00.000000")},
        "common_close": {"common_values": F.transform("common_values", lambda x: F.struct(x["value"].alias("value"), (x["n"] + F.col("total_count")).alias("n")))},
    }
    for name, figures in wrong.items():
        monkeypatch.setattr(profiles.st, "approx_profile", lambda df, figures=figures, **kw: real(df, **kw).withColumns(figures))
        rows = {r["column_name"]: r for r in QUERIES["c18_sketch_bounds"](spark, sf_dir).collect()}
        assert len(rows) == 11
        # Columns of nearly unique values have no frequent ones.
        of = {"l_quantity", "l_tax", "l_returnflag", "l_linestatus"} if name == "common_close" else set(rows)
        assert all(r[c] is (c != name) for k, r in rows.items() if k in of for c in wrong)
