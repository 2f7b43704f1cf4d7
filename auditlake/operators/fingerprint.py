"""Fingerprints of tables and what changed between two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.exprs import count_if, as_double, ratio
from auditlake.operators.inventory import size_class
from auditlake.operators.profile import _columns, type_family
from auditlake.operators.quality import column_classes
from auditlake.session import materialize

# Hash length and the limits of the change classes.
HASH_LENGTH = 16
INCREMENTAL_BELOW, FULL_FROM = 0.3, 0.5


def column_components(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Type family and pattern classes per column; what a fingerprint is made of."""
    kinds = {f.name: type_family(f.dataType) for f in df.schema.fields}
    df, cols = _columns(df, cols)
    family = F.lit(None).cast("string")
    for c in cols:
        family = F.when(F.col("column_name") == c, kinds[c]).otherwise(family)
    return column_classes(df, cols).withColumn("type_family", family)


def table_fingerprint(
    name: str, df: DataFrame, links: list[str] | None = None, cols: list[str] | None = None
) -> DataFrame:
    """One short hash of a table's structure, links, value patterns and size class; one pass."""
    line = F.concat_ws(
        "|", "column_name", "type_family", "cardinality_class", "null_class", "length_class", "content_class"
    )
    # One line per column of the table: bounded by its schema.
    body = column_components(df, cols).agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"), F.max("total_count").alias("_n")
    )
    text = F.concat_ws("\n", F.lit(name), "body", F.lit(";".join(sorted(links or []))), size_class(F.col("_n")))
    return body.select(
        F.lit(name).alias("table_name"), F.substring(F.sha2(text, 256), 1, HASH_LENGTH).alias("fingerprint")
    )


def row_hash(cols: list[str]) -> Column:
    """md5 of all values of a row. Each carries its length, a null a mark without one: no two rows read alike.

    Nested columns are hashed as the JSON text that ``flattened`` makes of them.
    """
    text = lambda c: F.col(c).cast("string")
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in cols]))


def content_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Row count and the sums of both halves of the row hashes: any row order, and partial sums can be merged."""
    df, cols = _columns(df, cols)
    halves = df.select(row_hash(cols).alias("h"))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 16), 16, 10).cast("decimal(20,0)")).cast("string"), F.lit("0"))
    return halves.agg(F.count("*").alias("row_count"), F.concat_ws(":", half(1), half(17)).alias("hash_sum"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Each row's key with its status: added, removed, changed or unchanged.

    Keys are compared null-safely. Rows that share a key are matched by their
    hashes first; of what is left as many count as changed as both sides have.
    Equal snapshots are unchanged row by row, whatever their keys.
    """
    side = lambda df, o, n: df.select(F.col(key), F.col(hash_col).alias("_h"), F.lit(o).alias("_o"), F.lit(n).alias("_n"))
    both = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(key, "_h").agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))
    per_key = both.groupBy(key).agg(F.sum(F.least("_o", "_n")).alias("_same"), F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))
    gone, come = F.col("_o") - F.col("_same"), F.col("_n") - F.col("_same")
    changed = F.least(gone, come)
    counts = [("unchanged", F.col("_same")), ("changed", changed), ("removed", gone - changed), ("added", come - changed)]
    told = per_key.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("status"), n.alias("_times")) for s, n in counts])))
    rows = told.filter(F.col("_times") > 0)
    return rows.select(key, "status", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_i")).drop("_i")


def snapshot_diff(changes: DataFrame) -> DataFrame:
    """Counts per status, the share of changes, its class, and whether to start over."""
    row = changes.agg(
        *[count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")]
    )
    moved = F.col("added") + F.col("removed") + F.col("changed")
    present = F.col("added") + F.col("changed") + F.col("unchanged")
    share = ratio(moved, F.greatest(present, F.lit(1)))
    return row.withColumn("change_ratio", as_double(share)).withColumn(
        "change_type",
        F.when(moved == 0, "no_change").when(share < INCREMENTAL_BELOW, "incremental").otherwise("major"),
    ).withColumn("full_rerun", share >= FULL_FROM)


def component_diff(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """Which components of a table changed; structural changes weigh high."""
    patterns = ["cardinality_class", "null_class", "length_class", "content_class"]
    def parts(df: DataFrame, mark: str) -> DataFrame:
        return column_components(df).select(
            "column_name",
            F.struct("type_family").alias(f"_type_{mark}"),
            F.struct(*patterns).alias(f"_pattern_{mark}"),
            size_class(F.col("total_count")).alias(f"_size_{mark}"),
        )

    both = parts(old, "old").join(parts(new, "new"), "column_name", "full_outer")

    def differs(part: str) -> Column:
        return F.coalesce(F.max(~F.col(f"_{part}_old").eqNullSafe(F.col(f"_{part}_new"))), F.lit(False))

    row = both.agg(
        differs("type").alias("structural_changed"),
        differs("pattern").alias("data_patterns_changed"),
        (F.max("_size_old") != F.max("_size_new")).alias("metadata_changed"),
    )
    changed = F.col("structural_changed") | F.col("data_patterns_changed") | F.col("metadata_changed")
    return row.select(
        F.lit(name).alias("table_name"),
        changed.alias("table_changed"),
        "structural_changed",
        "data_patterns_changed",
        "metadata_changed",
        F.when(F.col("structural_changed"), "high").when(changed, "low").otherwise("none").alias("impact"),
    )


def recompute_plan(changes: DataFrame) -> DataFrame:
    """The entries to profile again: added and changed ones; removed ones too when starting over."""
    summary = snapshot_diff(changes).select(F.struct("full_rerun", "change_type").alias("s")).scalar()
    kept = changes.withColumn("_s", summary)
    due = F.col("status").isin("added", "changed") | (F.col("_s.full_rerun") & (F.col("status") == "removed"))
    reason = F.concat(
        F.when(F.col("_s.full_rerun"), "major_changes_").otherwise("incremental_changes_"), F.col("_s.change_type")
    )
    return kept.filter(due).withColumn("reason", reason).drop("_s")


def fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_fingerprint(n, df) for n, df in tables.items()])


COMPONENTS = ("structural", "relational", "data_patterns", "metadata")
_PATTERNS = ("cardinality_class", "null_class", "length_class", "content_class")


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_LENGTH)


def _leaves(name: str, df: DataFrame, key: list[str], links: list[str]) -> DataFrame:
    """(table_name, component, part, value): all that a table's fingerprint is made of; one pass."""
    leaf = lambda component, part, value: F.struct(
        F.lit(name).alias("table_name"), F.lit(component).alias("component"), part.alias("part"), value.alias("value")
    )
    found = column_components(df)
    column = F.col("column_name")
    own = found.select(
        F.inline(F.array(leaf("structural", column, F.col("type_family")), leaf("data_patterns", column, F.concat_ws("|", *_PATTERNS)))), "total_count"
    )
    # As many rows as the table has columns: the size goes along with one of them.
    size = own.agg(F.inline(F.array(leaf("metadata", F.lit("size"), size_class(F.coalesce(F.max("total_count"), F.lit(0)))))))
    stated = [leaf("relational", F.lit("key"), F.lit(",".join(sorted(key))))] + [leaf("relational", F.lit("link"), F.lit(x)) for x in sorted(links)]
    return own.drop("total_count").unionByName(size).unionByName(df.sparkSession.range(1).select(F.inline(F.array(*stated))))


def fingerprint_tree(
    tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, links: dict[str, list[str]] | None = None
) -> DataFrame:
    """The fingerprint of a schema as a hash tree: schema, tables, their components, and what these consist of.

    Rows (level, table_name, component, part, fingerprint). Levels are schema,
    table, component and leaf; a node's fingerprint is that of the sorted
    fingerprints below it. Leaves are the columns' type families (structural) and
    value classes (data_patterns), the table's key and its links, each as
    ``column->table.column`` (relational), and its size class (metadata).
    """
    keys, links = keys or {}, links or {}
    leaves = reduce(DataFrame.unionByName, [_leaves(n, df, keys.get(n, []), links.get(n, [])) for n, df in tables.items()])
    # A few rows per column, read once for every level.
    leaves = materialize(leaves.withColumn("fingerprint", _short(F.concat_ws("=", "component", "part", "value"))))
    over = lambda: _short(F.array_join(F.array_sort(F.collect_list("fingerprint")), "\n"))
    components = leaves.groupBy("table_name", "component").agg(over().alias("fingerprint"))
    named = components.groupBy("table_name").agg(over().alias("_h")).select("table_name", _short(F.concat_ws("\n", "table_name", "_h")).alias("fingerprint"))
    schema = named.agg(_short(F.concat_ws("\n", F.count("*").cast("string"), F.array_join(F.array_sort(F.collect_list("fingerprint")), "\n"))).alias("fingerprint"))
    none = F.lit(None).cast("string")
    rows = lambda df, level, table, component, part: df.select(
        F.lit(level).alias("level"), table.alias("table_name"), component.alias("component"), part.alias("part"), "fingerprint"
    )
    table, component, part = F.col("table_name"), F.col("component"), F.col("part")
    return (
        rows(schema, "schema", none, none, none)
        .unionByName(rows(named, "table", table, none, none))
        .unionByName(rows(components, "component", table, component, none))
        .unionByName(rows(leaves, "leaf", table, component, part))
    )


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two trees, per table whose fingerprint differs.

    (table_name, status, a flag per component, impact, changed_parts). Only tables
    with different fingerprints are looked into, and of these only components that
    differ. Structural and relational changes weigh high, as do tables that came or went.
    """

    def differing(level: str, keys: list[str], within: DataFrame | None, on: list[str]) -> DataFrame:
        a, b = (
            t.filter(F.col("level") == level).select(*keys, F.col("fingerprint").alias(f"_{side}")) for t, side in ((old, "old"), (new, "new"))
        )
        if within is not None:
            a, b = (t.join(within.select(*on).distinct(), on, "left_semi") for t in (a, b))
        return a.join(b, keys, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))

    tables = differing("table", ["table_name"], None, [])
    components = differing("component", ["table_name", "component"], tables, ["table_name"])
    # Leaves are told apart by their fingerprint too: a table may have several links.
    leaf = lambda t: t.filter(F.col("level") == "leaf").select("table_name", "component", "part", "fingerprint").join(
        components.select("table_name", "component"), ["table_name", "component"], "left_semi"
    )
    parts = leaf(old).exceptAll(leaf(new)).unionByName(leaf(new).exceptAll(leaf(old))).select("table_name", F.concat_ws(".", "component", "part").alias("p"))
    listed = parts.groupBy("table_name").agg(F.array_sort(F.collect_set("p")).alias("changed_parts"))
    flags = components.groupBy("table_name").agg(*[F.max(F.col("component") == c).alias(f"{c}_changed") for c in COMPONENTS])
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    out = tables.join(flags, "table_name", "left").join(listed, "table_name", "left")
    heavy = F.col("structural_changed") | F.col("relational_changed")
    return out.select(
        "table_name", status.alias("status"), *[F.coalesce(f"{c}_changed", F.lit(False)).alias(f"{c}_changed") for c in COMPONENTS],
        F.when(heavy, "high").otherwise("low").alias("impact"), "changed_parts",
    )
