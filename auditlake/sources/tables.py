"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SUFFIX = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "jsonl"}


def load(
    spark: SparkSession,
    base: str,
    name: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Scan one table below ``base``.

    Text formats want a schema; without one Spark has to read the data twice.
    """
    path = f"{base.rstrip('/')}/{name}.{SUFFIX[fmt]}"
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if fmt == "json":
        reader = reader.option("multiLine", True)
    reader = reader.options(**(options or {}))
    return reader.format("json" if fmt == "jsonl" else fmt).load(path)


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A database table through Spark's own JDBC source, read in parallel slices."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", str(partitions))
        )
    return reader.options(**(options or {})).load()
