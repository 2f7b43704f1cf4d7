"""Table inventory: size, width and the classes derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.exprs import ladder, literal_table

# Size limits in rows and bytes, and the limits of the capacity report.
ROW_CLASSES = [(10_000_000, "very_large"), (100_000, "large"), (1_000, "medium"), (1, "small")]
BYTE_CLASSES = [(1024**3, "very_large"), (100 * 1024**2, "large"), (1024**2, "medium")]
LARGE_ROWS = 100_000
WIDE_COLUMNS = 20


def size_class(rows: Column) -> Column:
    return ladder(rows, ROW_CLASSES, "empty")


def storage_class(size: Column) -> Column:
    return ladder(size, BYTE_CLASSES, "small")


def table_inventory(tables: dict[str, DataFrame], with_bytes: bool = True) -> DataFrame:
    """One row per table: columns, rows, bytes on disk, classes.

    Counts rows per file, so no data column is read. ``with_bytes`` needs
    DataFrames that come straight from a file reader.
    """
    spark = next(iter(tables.values())).sparkSession
    size = F.col("_metadata.file_size") if with_bytes else F.lit(None).cast("bigint")
    path = F.col("_metadata.file_path") if with_bytes else F.lit("")
    scans = [
        df.select(F.lit(name).alias("table_name"), path.alias("_path"), size.alias("_size"))
        for name, df in tables.items()
    ]
    files = (
        reduce(DataFrame.unionByName, scans)
        .groupBy("table_name", "_path", "_size")
        .agg(F.count("*").alias("_rows"))
    )
    found = files.groupBy("table_name").agg(
        F.sum("_rows").alias("row_count"), F.sum("_size").alias("size_bytes")
    )
    known = literal_table(
        spark, ["table_name", "column_count"], [(name, len(df.columns)) for name, df in tables.items()]
    ).withColumn("column_count", F.col("column_count").cast("bigint"))
    no_bytes = F.lit(0 if with_bytes else None).cast("bigint")
    return known.join(found, "table_name", "left").select(
        "table_name",
        "column_count",
        F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
        F.coalesce("size_bytes", no_bytes).alias("size_bytes"),
        size_class(F.coalesce("row_count", F.lit(0))).alias("size_class"),
        storage_class(F.coalesce("size_bytes", no_bytes)).alias("storage_class"),
    )


def capacity_report(inventory: DataFrame, large: int = LARGE_ROWS, wide: int = WIDE_COLUMNS) -> DataFrame:
    """Tables that are large by rows or wide by columns."""
    flagged = inventory.withColumn("is_large", F.col("row_count") > large).withColumn(
        "is_wide", F.col("column_count") > wide
    )
    return flagged.filter("is_large OR is_wide")
