"""How filters interact: survivors of every subset of filters, and what follows from them.

A document's failures decide which subsets of the filters it survives. That is
written as a word with one bit per subset; positional popcounts of the words, by
part and label, count the survivors of all subsets at once. Carry-save adders
fold words that weigh the same, so that single bits are looked at in a few words
only. Every order of the filters, and their Shapley values, follow from the counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import batches, byte_texts
from auditlake.session import materialize

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Per set of failed filters the word of surviving subsets: bit s is set where no failed filter is in s.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)
_CAPITALS, _SIGNS = bytes(range(65, 91)), re.compile(rb"[#$%&*|]")
#: Counters a task holds before it hands them on.
MOST_COUNTERS = 2048


def failures(text: bytes) -> int:
    """The text-only filters that a text fails: bit 0 for A (under 50 words) to bit 3 for D (holds a sign)."""
    words = text.split()
    n = len(words)
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (_SIGNS.search(text) is not None) << 3


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: the sum bits of three words and their carries."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def popcounts(words: np.ndarray) -> np.ndarray:
    """Per bit position the words that have it set.

    Words are added bit-wise in layers: of every three that weigh the same, one
    stays and one goes up to double weight, until few words of each weight are left.
    """
    counts = np.zeros(32, np.int64)
    weight = 1
    layer = words.astype(np.uint32, copy=False)
    while len(layer):
        carried = []
        while len(layer) > 2:
            third = len(layer) // 3
            kept, carry = _add(layer[:third], layer[third : 2 * third], layer[2 * third : 3 * third])
            carried.append(carry)
            layer = np.concatenate((kept, layer[3 * third :]))
        counts += weight * (layer[:, None] >> np.arange(32, dtype=np.uint32) & 1).sum(0, dtype=np.int64)
        layer = np.concatenate(carried) if carried else layer[:0]
        weight *= 2
    return counts


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(_id, part, failed, digest): filters A to D and a 256-bit digest per whole text."""

    def read(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            texts = byte_texts(batch.column(2))
            failed = pa.array([failures(t) for t in texts], pa.int32())
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), failed, digest], schema.names)

    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.col(text).alias("_text"))
    schema = StructType([rows.schema["_id"]]).add("part", "string").add("failed", "integer").add("digest", "binary")
    return rows.mapInArrow(read, schema)


def survivors(rows: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): surviving documents per part and subset of filters.

    ``rows`` has part, failed (a set of filters as bits), good and toxic. All
    subsets are listed for every part. Tasks hand on sums, so a part of any size
    is a few rows per task.
    """

    def counted(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def hand_on() -> pa.RecordBatch:
            names, sums = list(held), np.array(list(held.values())).transpose(0, 2, 1).reshape(-1, 3)
            columns = [pa.array(np.repeat(np.array(names, object), SUBSETS), pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(names)))]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], schema.names)

        for batch in iterator:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            part = np.asarray(coded.indices)
            order = np.argsort(part, kind="stable")
            words = WORDS[np.asarray(batch.column(1))[order]]
            marks = [np.asarray(batch.column(i).cast(pa.int8()))[order].astype(bool) for i in (2, 3)]
            cuts = np.concatenate((np.flatnonzero(np.diff(part[order], prepend=-1)), [len(order)]))
            for name, i, j in zip(coded.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True):
                w = words[i:j]
                held[name] = held.get(name, 0) + np.array([popcounts(w), *(popcounts(w[m[i:j]]) for m in marks)])
            if len(held) >= MOST_COUNTERS:
                yield hand_on()
        if held:
            yield hand_on()

    schema = StructType.fromDDL("part string, subset int, n long, good long, toxic long")
    found = rows.select("part", "failed", "good", "toxic").mapInArrow(counted, schema)
    return found.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _steps(spark: SparkSession) -> DataFrame:
    """What each step of each order takes from the survivors of which subset, as signed shares: a fixed table."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order):
            after, alone, rest = before | 1 << f, 1 << f, (SUBSETS - 1) ^ (1 << f)
            shares: dict[int, np.ndarray] = {}
            # Columns: kept, removed, redundant, unique_fails.
            for subset, share in (
                (after, (1, -1, 1, 0)), (before, (0, 1, -1, 0)), (0, (0, 0, 1, 0)), (alone, (0, 0, -1, 0)), (rest, (0, 0, 0, 1)), (SUBSETS - 1, (0, 0, 0, -1)),
            ):
                shares[subset] = shares.get(subset, 0) + np.array(share)
            rows += [(name, step + 1, s, *map(int, share)) for s, share in shares.items()]
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, kept int, removed int, redundant int, unique_fails int")


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the table of ``survivors``."""
    steps = _steps(counts.sparkSession)
    share = lambda of, by: F.sum(F.col(of) * F.col(by)).alias(by)
    # The table of steps is fixed: some 3,000 rows whatever the data.
    told = counts.join(F.broadcast(steps), "subset").groupBy("part", "filter_order", "step").agg(
        *(share("n", c) for c in ("kept", "removed", "redundant", "unique_fails")),
        F.sum(F.col("good") * F.col("removed")).alias("good_lost"),
        F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"),
    )
    turns = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows
    return told.withColumn("shapley", F.sum("removed").over(turns))


def _marked(labels: DataFrame, doc_id: str, quality: str, toxic: str) -> DataFrame:
    """(_id, good, toxic) per labelled id; of several labels of an id one that says so is enough."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(said(quality).alias("good"), said(toxic).alias("toxic"))


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: str = "quality", toxic: str = "toxic"
) -> DataFrame:
    """Counts per part (source), order of the filters A to E, and step.

    A: under 50 words. B: distinct words under 65 % of the words. C: capitals A-Z
    over 5 % of the code points. D: a sign of ``#$%&*|``. E: the text of a smaller
    id. Null and empty texts are the same text. A null source is the part of empty
    name. A null id has no label and no smaller id; a repeated row is not smaller
    than itself, so both pass E. An empty table gives no part. Columns beside those
    named are not looked at, whatever their names.
    """
    rows = judged(docs, doc_id, text, source).join(_marked(labels, doc_id, quality, toxic), "_id", "left")
    no = F.lit(False)
    rows = materialize(
        rows.select("_id", "part", "failed", "digest", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    )
    first = rows.groupBy("digest").agg(F.min("_id").alias("_id")).withColumn("first", F.lit(True))
    # Id and text together find a text's first row: a text with many copies is many keys.
    later = F.col("_id").isNotNull() & F.col("first").isNull()
    placed = rows.join(first, ["digest", "_id"], "left").withColumn("failed", F.col("failed") + F.when(later, 16).otherwise(0))
    return report(survivors(placed))
