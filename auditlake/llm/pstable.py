"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

A unit vector is projected on random directions, shifted and cut into steps of
``width``; ``projections`` steps together are its bucket in one table, and there
are several ``tables``. Unit vectors with cosine c lie sqrt(2 - 2c) apart, so near
ones share a bucket in some table. Inside a bucket all cosines are computed in
double precision by blocks. Links are counted, never listed: a block hands on,
per vector, its number of links and the smallest vector it is tied to there. A
pair that meets in several tables counts in the first of them only.

Equal vectors of a label are one class, compared once with a weight, so a group of
copies costs no more than one vector. A bucket over ``block`` classes is cut into blocks
that meet pairwise in separate tasks, so a hot bucket is spread out and no row is
dropped. More projections per table for more rows per label keep the buckets
small, and more tables then keep the chance of a link to be found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.components import components
from auditlake.session import materialize

TABLES, PROJECTIONS, WIDTH, BLOCK = 24, 8, 2.0, 1024
#: Unrelated classes that share a bucket on average, and the chance of a link at the limit to be missed, by plan.
CROWD, MISSED = 64.0, 5e-4


def collision_chance(cosine: float, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> float:
    """Chance that two unit vectors of this cosine share a bucket in some table."""
    return 1 - (1 - _one(cosine, width) ** projections) ** tables


def _one(cosine: float, width: float) -> float:
    """Chance that one quantised projection is the same."""
    from math import erf, exp, pi, sqrt

    r = width / sqrt(max(1e-12, 2 - 2 * cosine))
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def planned(rows: int, cosine: float, width: float = WIDTH) -> tuple[int, int]:
    """(tables, projections) for so many rows per label; both grow slowly, and are ``TABLES`` and ``PROJECTIONS`` at least."""
    from math import ceil, log

    projections = max(PROJECTIONS, ceil(log(max(1.0, rows / CROWD)) / -log(_one(0.0, width))))
    tables = ceil(log(MISSED) / log(1 - _one(cosine, width) ** projections)) if cosine < 1 else 1
    return max(TABLES, tables), projections


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors that may link: no null, no non-finite part, not zero."""
    rows = column.to_pylist()
    good = [i for i, v in enumerate(rows) if v and None not in v]
    size = max((len(rows[i]) for i in good), default=0)
    x = np.zeros((len(good), size))
    for k, i in enumerate(good):
        x[k, : len(rows[i])] = rows[i]
    keep = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
    x = x[keep]
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)  # no overflow of squares
    return np.array(good, np.int64)[keep], x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(size: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, size])
    count = tables * projections
    return rng.normal(size=(size, count)), rng.uniform(0, width, count), rng.integers(1, 2**62, count, np.int64) | 1


def _meet(ids: np.ndarray, own: np.ndarray, x: np.ndarray, keys: np.ndarray, side: np.ndarray, table: int, cross: bool, cosine: float):
    """Links inside one bucket (or between its two blocks): (rows, linked vectors, smallest tied id). ``own``: vectors per class."""
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(len(ids)),) * 2
    counts, tied = np.zeros(len(ids), np.int64), ids.copy()
    pairs_a, pairs_b = [], []
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        keep = ids[i] != ids[j] if cross else (ids[i] != ids[j]) & (i < j)
        i, j = i[keep], j[keep]
        if table:
            first = (keys[i, :table] != keys[j, :table]).all(1)
            i, j = i[first], j[first]
        # Sums of whole numbers far below 2^53.
        counts += np.bincount(i, own[j], len(ids)).astype(np.int64) + np.bincount(j, own[i], len(ids)).astype(np.int64)
        pairs_a.append(i)
        pairs_b.append(j)
    a, b = np.concatenate(pairs_a or [[]]).astype(int), np.concatenate(pairs_b or [[]]).astype(int)
    while len(a):  # spread the smallest id along the links until nothing changes
        low = tied.copy()
        np.minimum.at(low, a, tied[b])
        np.minimum.at(low, b, tied[a])
        if (low == tied).all():
            break
        tied = low
    return np.flatnonzero(counts), counts, tied


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", cosine: float = 0.93,
    tables: int | None = None, projections: int | None = None, width: float = WIDTH, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine is at
    least ``cosine``; null and zero vectors and those with a null or non-finite
    part link with nothing, nor do vectors of different length or with a null id. ``n_links``
    counts other ids, ``component_id`` is the smallest id reachable. A repeated
    row counts once and gives repeated results. Tables and projections follow the
    rows of the largest label (``planned``) where they are not given. Missed links
    are as likely as ``1 - collision_chance(cosine)``; no link is reported below the limit.
    """
    chosen = vectors.select(
        F.col(vec_id).cast("long").alias("_id"),
        F.col(embedding).alias("v"),
        (F.col(label).cast("string") if label else F.lit("")).alias("l"),
    )
    kind = chosen.schema["v"].dataType.simpleString()
    usable = chosen.filter("_id IS NOT NULL AND l IS NOT NULL AND v IS NOT NULL")
    members, classes = _classes(usable)
    classes = materialize(classes)
    if not tables or not projections:
        most = classes.groupBy("l").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        more, finer = planned(int(most), cosine, width)
        tables, projections = tables or more, projections or finer

    def dealt(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            rows, x = _usable(batch.column(1))
            sizes = np.array([len(v) for v in batch.column(1).take(pa.array(rows)).to_pylist()], int)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                a, shift, mix = _directions(int(size), tables, projections, width, seed)
                steps = np.floor((x[at, :size] @ a + shift) / width).astype(np.int64)
                with np.errstate(over="ignore"):
                    keys = (steps * mix).reshape(len(at), tables, projections).sum(2) + int(size)
                taken = batch.take(pa.array(rows[at]))
                keys = pa.array((keys >> 32).astype(np.int32).ravel())
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.ListArray.from_arrays(offsets, keys)], ["_id", "v", "l", "own", "keys"]
                )

    # Hashes are computed once: the same keys deal the rows out and tell which table comes first.
    hashed = materialize(classes.mapInArrow(dealt, f"_id long, v {kind}, l string, own long, keys array<int>"))
    buckets = hashed.select("_id", "l", F.posexplode("keys").alias("t", "key"))
    sizes = buckets.groupBy("l", "t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = buckets.join(sizes, ["l", "t", "key"]).withColumn("of", blocks)
    own = F.pmod(F.xxhash64("_id"), F.col("of")).cast("int")
    tasks = (
        placed.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        .select(
            "_id",
            F.col("t").cast("int").alias("t"),
            F.xxhash64("l", "t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
            (F.col("own") > F.col("other")).alias("side"),
            (F.col("own") != F.col("other")).alias("cross"),
        )
    )

    def compared(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if not held.num_rows:
                continue
            task = held.column("task").to_numpy()
            whole = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
            if whole:
                yield from _compare(held.slice(0, whole), cosine)
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from _compare(held, cosine)

    dealt_out = tasks.join(hashed.select("_id", "v", "own", "keys"), "_id").repartition("task").sortWithinPartitions("task", "_id")
    found = materialize(
        dealt_out.select("task", "t", "cross", "side", "_id", "v", "keys", "own").mapInArrow(compared, "_id long, n long, tied long")
    )
    links = found.groupBy("_id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("_id").alias("a"), F.col("tied").alias("b"))).withColumnRenamed("node", "_id")
    told = links.join(roots, "_id", "full_outer").withColumnRenamed("_id", "first")
    each = members.join(told, "first", "left").select(
        "_id", (F.col("own") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "first").alias("root")
    )
    out = chosen.select("_id").join(each, "_id", "left")
    return out.select(
        F.col("_id").alias(vec_id),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "_id").alias("component_id"),
        F.coalesce(F.coalesce("root", "_id") == F.col("_id"), F.lit(False)).alias("kept"),
    )


def _classes(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (_id, first, own), and classes (_id, v, l, own): equal vectors of a label, named by their smallest id.

    ``own`` is the number of ids in a class. An id that stands for several vectors
    is in no class with others: each of its vectors goes by that id, alone.
    """
    key = [F.xxhash64(F.lit(s), "l", "v").alias(f"k{s}") for s in (1, 2)]
    narrow = usable.select("_id", *key).distinct()
    several = narrow.groupBy("_id").agg(F.count("*").alias("of")).filter("of > 1").select("_id", F.lit(True).alias("alone"))
    named = materialize(narrow.join(several, "_id", "left"))
    single = named.filter("alone IS NULL")
    first = single.groupBy("k1", "k2").agg(F.min("_id").alias("first"), F.count("*").alias("own"))
    one = F.lit(1).cast("long").alias("own")
    members = materialize(
        single.join(first, ["k1", "k2"]).select("_id", "first", "own").unionByName(
            named.filter("alone").select("_id", F.col("_id").alias("first"), one).distinct()
        )
    )
    names = members.filter("_id = first").select("_id", "own")
    return members, usable.join(names, "_id").select("_id", "v", "l", "own").distinct()


def _compare(rows: pa.Table, cosine: float) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    task = rows.column("task").to_numpy()
    edges = np.concatenate(([0], np.flatnonzero(np.diff(task)) + 1, [len(task)]))
    ids, t, own = (rows.column(c).to_numpy() for c in ("_id", "t", "own"))
    side = rows.column("side").to_numpy(zero_copy_only=False)
    cross = rows.column("cross").to_numpy(zero_copy_only=False)
    _, x = _usable(rows.column("v").combine_chunks())
    k = np.array(rows.column("keys").to_pylist(), np.int32).reshape(len(task), -1)
    out: list[list[np.ndarray]] = [[], [], []]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j - i < 2:
            continue
        at, counts, tied = _meet(ids[i:j], own[i:j], x[i:j], k[i:j], side[i:j], int(t[i]), bool(cross[i]), cosine)
        if len(at):
            for part, values in zip(out, (ids[i:j][at], counts[at], tied[at]), strict=True):
                part.append(values)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in out], ["_id", "n", "tied"])
