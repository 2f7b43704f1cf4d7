"""Readers, writers and the inventory."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import inventory, sampling
from auditlake.session import scratch_path, shared_dir
from auditlake.sources import sinks
from auditlake.sources.tables import load


def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "jsonl"])
def test_formats(spark, sf_dir, fmt):
    df = load(spark, sf_dir, "supplier")
    base = folder()
    writer = df.write.option("header", True)
    writer.format("json" if fmt == "jsonl" else fmt).save(f"{base}/supplier.{fmt}")
    back = load(spark, base, "supplier", fmt, df.schema)
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()


def test_json_document(spark):
    base = folder()
    with open(f"{base}/t.json", "w") as out:
        json.dump([{"a": 1, "b": "x"}, {"a": 2, "b": None}], out, indent=1)
    got = load(spark, base, "t", "json", "a bigint, b string").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, None)]


def test_csv_without_schema(spark):
    base = folder()
    with open(f"{base}/t.csv", "w") as out:
        out.write("a,b\n1,x\n2,y\n")
    assert load(spark, base, "t", "csv").dtypes == [("a", "int"), ("b", "string")]


def test_export_quotes_and_nulls(spark):
    rows = [(1, 'say "hi", you'), (2, None), (3, "line\nbreak")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    path = sinks.export(df, folder() + "/out", "csv")
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert sorted(map(tuple, back.collect())) == rows
    path = sinks.export(df, folder() + "/out", "json")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(path).collect())) == rows
    with pytest.raises(ValueError):
        sinks.export(df, folder() + "/out", "xml")


def test_replace_partition_keeps_the_rest(spark):
    path = folder() + "/t"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id bigint, g string")
    sinks.replace_partition(df, path, "g")
    sinks.replace_partition(spark.createDataFrame([(9, "b")], "id bigint, g string"), path, "g")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (9, "b")]


def test_inventory_bytes(spark, sf_dir):
    row = inventory.table_inventory({"orders": load(spark, sf_dir, "orders")}).first()
    assert row["size_bytes"] == os.path.getsize(f"{sf_dir}/orders.parquet")
    assert row["storage_class"] == "small"


def test_inventory_reads_no_columns(spark, sf_dir):
    df = inventory.table_inventory({"orders": load(spark, sf_dir, "orders")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


@pytest.mark.parametrize(
    "rows,label", [(0, "empty"), (1, "small"), (999, "small"), (1000, "medium"), (100_000, "large"), (10_000_000, "very_large")]
)
def test_size_classes(spark, rows, label):
    assert spark.range(1).select(inventory.size_class(F.lit(rows)).alias("c")).first()["c"] == label


def test_capacity_report(spark):
    rows = [("a", 3, 100_000), ("b", 3, 100_001), ("c", 20, 5), ("d", 21, 5)]
    df = spark.createDataFrame(rows, "table_name string, column_count bigint, row_count bigint")
    assert sorted(r["table_name"] for r in inventory.capacity_report(df).collect()) == ["b", "d"]


def test_diverse_sample_takes_turns(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "big").otherwise("rare").alias("s"))
    picked = sampling.sample(df, 10, "diverse", key="id", stratum="s").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in picked} == {"big": 5, "rare": 5}
    with pytest.raises(ValueError):
        sampling.sample(df, 10, "best", key="id")


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named and scratch_path(spark, "x").startswith(named.rstrip("/"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
