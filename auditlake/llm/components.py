"""Connected components of a link table by alternating star contraction.

Each round replaces a node's links by links to its smallest neighbour, first for
larger neighbours (large star), then for smaller ones (small star). The table
never grows by more than its nodes, the rounds are logarithmic in practice, and
only two numbers per round reach the driver. Every round is checkpointed to the
shared folder, so that a lost executor does not undo earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); ``root`` is the smallest node reachable.

    Null ends, self links and repeated links do no harm. Nodes without a link are
    not in the result; an empty table gives an empty one.
    """
    edges = materialize(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _print(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)))
        now = _print(edges)
        if now == before:
            break
        before = now
    # At the end every link goes from a node to the root of its component.
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select("b", "b").distinct())


def _print(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour, itself included."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()
