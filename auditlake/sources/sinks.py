"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write a result as CSV with a header, JSON lines or parquet; one file per task."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
    return path


def replace_partition(df: DataFrame, path: str, group: str) -> str:
    """Replace the groups that occur in ``df`` and keep every other group at ``path``.

    Rows are brought together by group in partitions of Spark's advisory size:
    small groups share a task, a large one is spread over several, so a group has
    as many files as its size asks for.
    """
    (
        df.hint("rebalance", group).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(group)
        .parquet(path)
    )
    return path
