"""Missing audit data, orphans, key violations and reference cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.exprs import count_if, as_double, melt, ratio
from auditlake.functions.membership import holds, memberships
from auditlake.operators.profile import missing_values
from auditlake.session import materialize

# Thresholds of the detectors.
ORPHANS_HIGH = 100
UNVERIFIED_MIN = 2
CYCLE_DEPTH = 10
ROW_LIMIT = 100


def audit_gaps(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with any audit field null, and their percentage; one pass."""
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    row = df.agg(count_if(gap).alias("rows_without_audit"), F.count("*").alias("total_rows"))
    return row.withColumn(
        "percentage", as_double(F.coalesce(ratio(F.col("rows_without_audit") * 100, F.col("total_rows")), F.lit(0.0)))
    )


def critical_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count of each critical column."""
    return missing_values(df, cols).withColumnRenamed("missing", "null_count")


def permissive_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Critical columns that do hold nulls."""
    return critical_nulls(df, cols).filter(F.col("null_count") > 0).withColumn("risk_level", F.lit("medium"))


def orphan_counts(
    child_name: str, child: DataFrame, fks: list[tuple[str, str, DataFrame, str]]
) -> DataFrame:
    """Orphans per foreign key ``(column, parent name, parent, parent key)``, with severity.

    The child is read once for all its keys, and so is each parent; a null is no orphan.
    """
    tables, columns, ends = {"child": child}, [], []
    for column, _, parent, key in fks:
        same = next((n for n, df in tables.items() if df is parent and n != "child"), None)
        name = same or f"parent{len(tables)}"
        tables[name] = parent
        ends.append((("child", column), (name, key)))
        columns += [c for c in ends[-1] if c not in columns]
    place = {c: i for i, c in enumerate(columns)}
    lost = [
        F.coalesce(F.sum(F.when(holds(place[a]) & ~holds(place[b]), F.col(f"_n{place[a]}"))), F.lit(0)).cast("bigint").alias(f"_l{i}")
        for i, (a, b) in enumerate(ends)
    ]
    rows = [
        F.struct(
            F.lit(child_name).alias("child_table"), F.lit(column).alias("child_column"), F.lit(parent_name).alias("parent_table"),
            F.col(f"_l{i}").alias("orphan_count"),
        )
        for i, (column, parent_name, *_) in enumerate(fks)
    ]
    counted = melt(memberships(tables, columns, {place[a] for a, _ in ends}).agg(*lost), rows)
    return counted.withColumn(
        "risk_level",
        F.when(F.col("orphan_count") == 0, "none")
        .when(F.col("orphan_count") < ORPHANS_HIGH, "medium")
        .otherwise("high"),
    )


def orphan_rows(
    child: DataFrame, parent: DataFrame, column: str, parent_column: str, key: str, n: int = ROW_LIMIT
) -> DataFrame:
    """Child rows without a parent, first ``n`` by key. A null refers to nothing and is no orphan, as in ``orphan_counts``."""
    known = parent.select(F.col(parent_column).alias(column))
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti").orderBy(key).limit(n)


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)


def unverified_fks(relationships: DataFrame, min_n: int = UNVERIFIED_MIN) -> DataFrame:
    """Tables with more than ``min_n`` reference-like columns that no parent confirms."""
    broken = F.coalesce(F.col("inclusion_ratio"), F.lit(0.0)) < 1.0
    return (
        relationships.filter(broken)
        .groupBy(F.col("source_table").alias("table_name"))
        .agg(
            F.countDistinct("source_column").alias("unverified"),
            F.array_join(F.array_sort(F.collect_set("source_column")), ", ").alias("columns"),
        )
        .filter(F.col("unverified") > min_n)
        .withColumn("risk_level", F.lit("medium"))
    )


def cycles(df: DataFrame, key: str, ref: str, max_depth: int = CYCLE_DEPTH) -> DataFrame:
    """Reference cycles of up to ``max_depth`` rows, each once, from its smallest key.

    A path is given up as soon as it meets a key below its start, and rows
    nothing points to are dropped first, so the frontier shrinks quickly. Each
    step is written to the shared folder: a lost executor repeats one step.
    """
    edges = df.filter(F.col(ref).isNotNull()).select(F.col(key).alias("_id"), F.col(ref).alias("_to")).distinct()
    edges = edges.join(edges.select(F.col("_to").alias("_id")).distinct(), "_id", "left_semi")
    edges = materialize(edges)

    start = edges.filter(F.col("_to") >= F.col("_id")).select(
        F.col("_id").alias("start"), F.col("_to").alias("_at"), F.array("_id").alias("path")
    )
    closed: list[DataFrame] = []
    frontier = start
    for depth in range(1, max_depth + 1):
        frontier = materialize(frontier)
        closed.append(
            frontier.filter(F.col("_at") == F.col("start")).select(
                "start", F.lit(depth).cast("bigint").alias("length"), "path"
            )
        )
        open_paths = frontier.filter(F.col("_at") > F.col("start"))
        if depth == max_depth or open_paths.isEmpty():
            break
        step = open_paths.join(edges, open_paths["_at"] == edges["_id"])
        fresh = ~F.array_contains("path", F.col("_id")) & (F.col("_to") >= F.col("start"))
        frontier = step.filter(fresh).select(
            "start", F.col("_to").alias("_at"), F.array_append("path", F.col("_id")).alias("path")
        )
    return reduce(DataFrame.unionByName, closed)


def is_reference_like(field: T.StructField) -> bool:
    return field.name.lower().endswith(("_id", "key"))

