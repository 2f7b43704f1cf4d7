"""Relationship discovery: candidates by name, checked by value."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.exprs import as_double, count_if, melt, no_rows, ratio
from auditlake.functions.membership import holds, memberships
from auditlake.operators.integrity import is_reference_like

NAME_CONFIDENCE = 0.8  # fixed value: confidence of a match by name alone
DENSITY_STEPS = ((1.5, "high"), (0.5, "medium"))  # fixed values: links per table
STRONG_LINKS = 2  # fixed value: more links than this make a table's strength high


def _stem(column: str) -> str:
    """Column name without a one- or two-letter table prefix."""
    return re.sub(r"^[a-z]{1,2}_", "", column.lower())


def candidate_pairs(
    tables: dict[str, DataFrame], keys: dict[str, str]
) -> list[tuple[str, str, str | None, str | None]]:
    """(table, column, parent, parent key) for each reference-like column; no parent as None.

    A column ``x_id`` names the tables x, xs and x without its s; a column also
    names the table whose key has the same stem.
    """
    pairs = []
    for name, df in tables.items():
        for f in df.schema.fields:
            if not is_reference_like(f) or keys.get(name) == f.name:
                continue
            low = f.name.lower()
            stem = low[:-3] if low.endswith("_id") else None
            parents = [
                parent
                for parent, key in keys.items()
                if parent != name
                and (
                    _stem(key) == _stem(f.name)
                    or (stem is not None and stem in (parent.lower(), parent.lower().rstrip("s"), parent.lower() + "s"))
                )
            ]
            pairs += [(name, f.name, p, keys[p]) for p in parents] or [(name, f.name, None, None)]
    return pairs


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Share of distinct child values found in the parent key."""
    have = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    known = parent.select(F.col(key).alias("_v"), F.lit(1).alias("_hit")).distinct()
    return have.join(known, "_v", "left").agg(
        F.count("*").alias("child_values"),
        F.count("_hit").alias("matched_values"),
        as_double(ratio(F.count("_hit"), F.count("*"))).alias("inclusion_ratio"),
    )


RELATIONSHIP = (
    "source_table string, source_column string, target_table string, target_column string, confidence double, "
    "child_values bigint, matched_values bigint, inclusion_ratio double, verified boolean"
)


def discover_relationships(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Candidate links with the share of child values the parent holds.

    All candidates are checked together: each table is read once, and one shuffle
    brings equal values of all columns together.
    """
    pairs = candidate_pairs(tables, keys)
    if not pairs:
        return no_rows(next(iter(tables.values())), RELATIONSHIP)
    linked = [p for p in pairs if p[2] is not None]
    columns = list(dict.fromkeys([(t, c) for t, c, *_ in linked] + [(p, k) for *_, p, k in linked]))
    place = {c: i for i, c in enumerate(columns)}
    none = lambda kind: F.lit(None).cast(kind)
    aggs, rows = [F.lit(1).alias("_one")], []
    for n, (name, column, parent, key) in enumerate(pairs):
        values = matched = none("bigint")
        if parent is not None:
            child, known = place[name, column], place[parent, key]
            aggs += [count_if(holds(child)).alias(f"_a{n}"), count_if(holds(child) & holds(known)).alias(f"_b{n}")]
            values, matched = F.col(f"_a{n}"), F.col(f"_b{n}")
        share = as_double(ratio(matched, values)) if parent is not None else none("double")
        rows.append(
            F.struct(
                F.lit(name).alias("source_table"),
                F.lit(column).alias("source_column"),
                F.lit(parent).cast("string").alias("target_table"),
                F.lit(key).cast("string").alias("target_column"),
                F.lit(NAME_CONFIDENCE if parent else None).cast("double").alias("confidence"),
                values.alias("child_values"),
                matched.alias("matched_values"),
                share.alias("inclusion_ratio"),
                F.coalesce(share == 1.0, F.lit(False)).alias("verified"),
            )
        )
    if not linked:
        return melt(next(iter(tables.values())).sparkSession.range(1), rows)
    return melt(memberships(tables, columns).agg(*aggs), rows)


def _key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_k"))
        .agg(F.count("*").alias(name))
    )


def cardinality(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """1:1, 1:many, many:1 or many:many, from the largest key group on each side."""
    left_max = _key_counts(left, left_key, "_n").agg(F.max("_n").alias("left_max"))
    right_max = _key_counts(right, right_key, "_n").agg(F.max("_n").alias("right_max"))
    row = left_max.withColumn("right_max", right_max.scalar())
    side = lambda c: F.when(F.col(c) > 1, "many").otherwise("1")
    return row.withColumn("cardinality", F.concat(side("left_max"), F.lit(":"), side("right_max")))


def join_selectivity(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Matching pairs as a share of all pairs, without forming the pairs."""
    a = _key_counts(left, left_key, "_a")
    b = _key_counts(right, right_key, "_b")
    pairs = F.sum(F.col("_a").cast("decimal(19,0)") * F.col("_b").cast("decimal(19,0)"))
    row = a.join(b, "_k").agg(F.coalesce(pairs.cast("double"), F.lit(0.0)).alias("matches"))
    size = lambda df: df.agg(F.count("*").cast("double").alias("n")).scalar()
    return row.withColumn("_left", size(left)).withColumn("_right", size(right)).select(
        F.col("matches").cast("bigint").alias("matches"),
        F.round(ratio(F.col("matches"), F.col("_left") * F.col("_right")), 12).alias("selectivity"),
    )


def unique_keys(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Whether the key of each table is free of repeats and nulls."""
    rows = []
    for name, key in keys.items():
        counts = tables[name].groupBy(*key).agg(F.count("*").alias("_n"))
        bad = F.lit(False)
        for k in key:
            bad = bad | F.col(k).isNull()
        rows.append(
            counts.agg(F.count(F.when((F.col("_n") > 1) | bad, 1)).alias("_bad")).select(
                F.lit(name).alias("table_name"), (F.col("_bad") == 0).alias("key_verified")
            )
        )
    if not rows:
        return no_rows(SparkSession.active().range(0), "table_name string, key_verified boolean")
    return reduce(DataFrame.unionByName, rows)


def link_strength(inventory: DataFrame, relationships: DataFrame) -> DataFrame:
    """Verified links per table and their strength class."""
    links = (
        relationships.filter("verified")
        .groupBy(F.col("source_table").alias("table_name"))
        .agg(F.count("*").alias("_links"))
    )
    n = F.coalesce(F.col("_links"), F.lit(0).cast("bigint"))
    return inventory.select("table_name").join(links, "table_name", "left").select(
        "table_name",
        n.alias("links"),
        F.when(n > STRONG_LINKS, "high").when(n > 0, "medium").otherwise("low").alias("strength"),
    )


def schema_coverage(inventory: DataFrame, verified_keys: DataFrame, relationships: DataFrame) -> DataFrame:
    """Share of tables with a verified key and link, mean width, links per table and density."""
    links = link_strength(inventory, relationships)
    wide = inventory.select("table_name", "column_count").join(links, "table_name").join(
        verified_keys, "table_name", "left"
    )
    row = wide.agg(
        F.count("*").alias("tables"),
        as_double(F.avg(F.coalesce("key_verified", F.lit(False)).cast("double"))).alias("key_coverage"),
        as_double(F.avg((F.col("links") > 0).cast("double"))).alias("fk_coverage"),
        as_double(F.avg("column_count")).alias("avg_columns"),
        as_double(F.avg("links")).alias("links_per_table"),
    )
    density = F.lit("low")
    for limit, label in reversed(DENSITY_STEPS):
        density = F.when(F.col("links_per_table") > limit, label).otherwise(density)
    return row.withColumn("density", density)
