"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source fall into hash blocks, in a seeded order. A source is
taken whole as often as its target allows, and blocks in that order make up the
rest, up to the block that comes nearest. The block draws of all sources are then
dealt to the output shards: a binary tree over the shards splits the quotas, each
node handing its left half a multivariate-hypergeometric draw, so that shards get
equal numbers of blocks and every source spreads as in a random deal. A leaf takes
the next run of permuted blocks of each source, so no two shards share a draw,
and shuffles its documents locally.

What reaches the driver is one row per source, at most ``MOST_SOURCES``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import batches
from auditlake.session import materialize

BLOCKS, SHARDS, SHARE, COPIES = 1024, 32, 1.5, 2
WEIGHTS = (5.0, 2.0, 1.0)
MOST_SOURCES = 100_000
#: Words of a slice of a shard that one task shuffles, some 64 MB of text.
SLICE_WORDS = 10_000_000
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words per text of an Arrow column: places where a run without ASCII blanks begins."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (0, 0)
    if last == first:
        return np.zeros(len(column), np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[first:last]
    word = ~_BLANK[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = ends[:-1][ends[:-1] < last] - first
    begins[inner] = word[inner]  # a text begins anew
    return np.diff(np.concatenate(([0], np.cumsum(begins, dtype=np.int32)))[ends - first])


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, ceiling: float = COPIES) -> list[float]:
    """Targets by weight; those over ``ceiling`` sizes stop there and the excess is shared again."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = {i for i in open_ if left * weights[i] / weight > ceiling * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = ceiling * sizes[i]
        left -= sum(ceiling * sizes[i] for i in sorted(over))
        open_ -= over
    return targets


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): the quotas of each shard; columns sum to ``quotas``, rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    total = int(quotas.sum())
    edges = [total * i // shards for i in range(shards + 1)]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1:
            out[low] = here
            continue
        middle = (low + high) // 2
        draw = edges[middle] - edges[low]
        left = rng.multivariate_hypergeometric(here, draw, method="marginals") if len(here) else here
        stack += [(low, middle, left), (middle, high, here - left)]
    return out


@dataclass
class Mix:
    """``rows``: (_row..., _source, _block, _size) narrow rows; ``draws``: (_source, _block, _copy, _shard); ``targets`` per source."""

    rows: DataFrame
    draws: DataFrame
    targets: DataFrame


def _keyed(docs: DataFrame, source: Column, keys: Sequence[Column], blocks: int, seed: int) -> DataFrame:
    """``_source`` (null last, marked) and ``_block`` beside the columns of ``docs``."""
    marked = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))
    return docs.withColumns({"_source": marked, "_block": F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(blocks)).cast("int")})


def plan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 23,
) -> Mix:
    """Decide how often each block of each source is drawn, and for which shard.

    Sources in order of code points, null last, take the weights in turn. Null and
    empty texts have size zero; a source without words has target zero and is not
    drawn. Equal rows share a block and are drawn alike; a run with the same rows
    and seed gives the same mix. An empty table gives an empty plan.
    """
    spark = docs.sparkSession

    def sized(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 2000, 2 << 20):
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(word_counts(batch.column(3)))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_source", "_block", "_size"])

    narrow = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    chosen = _keyed(narrow, F.col("_from"), [F.col("_id"), F.col("_text")], blocks, seed).select("_id", "_source", "_block", "_text")
    schema = StructType([chosen.schema["_id"]]).add("_source", "string").add("_block", "integer").add("_size", "long")
    rows = materialize(chosen.mapInArrow(sized, schema))
    held = materialize(rows.groupBy("_source", "_block").agg(F.sum("_size").alias("words")))
    known = held.groupBy("_source").agg(F.sum("words").alias("size")).orderBy("_source").limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group the small ones first")
    # "=..." sorts before "~", so null comes last.
    sizes = [int(r["size"]) for r in known]
    goal = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    base = [min(COPIES, int(t // s)) if s else 0 for t, s in zip(goal, sizes, strict=True)]
    targets = spark.createDataFrame(
        [(r["_source"], s, float(t), b, float(t) - b * s) for r, s, t, b in zip(known, sizes, goal, base, strict=True)],
        "_source string, source_size long, target double, base int, rest double",
    )
    # Whole copies, and of the permuted blocks those up to the one that comes nearest to the rest.
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 1), "_source", "_block"), "_block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = held.join(targets, "_source").withColumn("end", F.sum("words").over(upto))
    extra = F.when(F.col("end") - F.col("words") / 2 <= F.col("rest"), 1).otherwise(0)
    drawn = run.withColumn("times", F.col("base") + F.when(F.col("base") < COPIES, extra).otherwise(0)).filter("times > 0")
    units = drawn.select("_source", "_block", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy"))
    # Copies of one block lie far apart in the permuted order of draws.
    turn = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 2), "_source", "_block", "_copy"), "_block", "_copy")
    units = units.withColumn("turn", F.row_number().over(turn))
    counts = {r["_source"]: r["n"] for r in units.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    split = splitting_tree(np.array([counts[n] for n in names], np.int64), shards, np.random.default_rng(seed))
    ends = np.cumsum(split, axis=0)
    runs = spark.createDataFrame(
        [(n, [int(x) for x in ends[:, i]]) for i, n in enumerate(names)], "_source string, ends array<long>"
    )
    draws = units.join(runs, "_source").select(
        "_source", "_block", "_copy", F.size(F.filter("ends", lambda e: e < F.col("turn"))).alias("_shard")
    )
    return Mix(rows, draws, targets)


def taken(mix: Mix) -> DataFrame:
    """(_id, size, source_size, target, taken) per document; ``taken`` counts its words times its draws."""
    times = mix.draws.groupBy("_source", "_block").agg(F.count("*").alias("times"))
    sizes = mix.targets.select("_source", "source_size", "target")
    return mix.rows.join(times, ["_source", "_block"], "left").join(sizes, "_source").select(
        "_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 23, **options) -> DataFrame:
    """The mixture: all columns of ``docs`` and ``_shard``, one row per draw, shuffled within each shard.

    The options are those of ``plan``. Rows of one shard stand together, cut into
    slices of some 64 MB. Nulls, empty texts and repeated rows are those of
    ``plan``; columns may have any name (the shard gets another underscore where
    its name is taken).
    """
    mix = plan(docs, doc_id, text, source, seed=seed, **options)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keys = [F.col(f"row.{c}") for c in (doc_id, text)]
    keyed = _keyed(docs.select(row), F.col(f"row.{source}"), keys, options.get("blocks", BLOCKS), seed)
    out = keyed.join(mix.draws, ["_source", "_block"])
    out = out.withColumn("_turn", F.xxhash64(F.lit(seed + 3), *keys, "_copy"))
    # A shard is spread over tasks by a further hash and shuffled there.
    words = mix.targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    slices = max(64, int(words / (options.get("shards", SHARDS) * SLICE_WORDS)))
    name = "_shard"
    while name in docs.columns:
        name += "_"
    spread = out.repartition("_shard", F.pmod("_turn", F.lit(slices))).sortWithinPartitions("_shard", "_turn")
    return spread.select("row.*", F.col("_shard").alias(name))


def document_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``taken`` of the mix of ``docs`` with the standard weights."""
    return taken(plan(docs)).withColumnRenamed("_id", "doc_id")
