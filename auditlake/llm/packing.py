"""Training sequences of balanced attention cost.

The cost of a document in a sequence is estimated as linear plus quadratic in its
tokens, since attention does not cross documents. Documents go, in descending
order, to the sequence of lowest cost that has room left; one that does not fit
fills the room, and its rest goes back in line. Room for exactly the tokens of a
block of documents is opened: sequences of full length, and for the remainder
sequences whose lengths are powers of two, which need no padding.

A block is a run of documents of one task, so nothing is shuffled: one pass reads,
encodes, packs and numbers. Memory is bounded by the tokens of a block and the
longest document.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import batches
from auditlake.llm.vocabularies import WORD_LEVEL, WordLevel, loaded

LENGTH, END = 2048, 1
#: Cost of a token without attention, in units of a token's attention to one other: six times the width of a model of 1024.
LINEAR = 6144.0
#: Tokens packed together.
BLOCK = 1 << 22


def rooms(tokens: int, length: int = LENGTH) -> list[int]:
    """Lengths of sequences for exactly so many tokens: full ones, then the powers of two that make up the remainder."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(sizes: list[int], length: int = LENGTH, linear: float = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """(document, start, size, sequence, offset) per piece, for documents of ``sizes`` tokens.

    Descending documents to the cheapest sequence with room; ties go to the
    sequence, and of equal sizes to the document, that comes first. A document of
    no tokens has no piece. Pieces of a sequence fill it without gaps.
    """
    room = rooms(sum(sizes), length)
    used = [0] * len(room)
    open_ = [(0.0, s) for s in range(len(room))]
    # A document longer than a sequence can fill some on its own; what it leaves competes as a piece.
    line = [(-min(n - at, length), d, at, min(n - at, length)) for d, n in enumerate(sizes) for at in range(0, n, length)]
    heapq.heapify(line)
    placed = []
    while line:
        _, d, start, size = heapq.heappop(line)
        cost, s = heapq.heappop(open_)
        fits = min(size, room[s] - used[s])
        placed.append((d, start, fits, s, used[s]))
        used[s] += fits
        if used[s] < room[s]:
            heapq.heappush(open_, (cost + fits * (linear + fits), s))
        if fits < size:
            heapq.heappush(line, (fits - size, d, start + fits, size - fits))
    return placed


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, linear: float = LINEAR,
    block: int = BLOCK, vocabulary: str = WORD_LEVEL, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ``ids`` on request.

    Whole texts are encoded, and ``END`` follows each. A null or empty text has
    that one token. A null id stays null; repeated rows are packed one by one, each
    in pieces of its own; an empty table gives none; other columns are not looked
    at. ``sequence_id`` is unique over the table and depends on the rows and their
    order in the input's partitions only, so a task that is run again gives the
    same. Sequences are full but for those whose length is a power of two.
    """

    def packed(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(WordLevel, vocabulary)
        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held, tokens
            names = pa.concat_arrays([x for x, _, _ in held])
            ids = np.concatenate([x for _, x, _ in held])
            sizes = np.concatenate([x for _, _, x in held])
            first = np.concatenate(([0], np.cumsum(sizes)))
            held, tokens = [], 0
            found = np.array(assign(sizes.tolist(), length, linear), np.int64).reshape(-1, 5)
            for at in range(0, len(found), 20_000):
                d, start, size, s, offset = found[at : at + 20_000].T
                cuts = [ids[i : i + n] for i, n in zip((first[d] + start).tolist(), size.tolist(), strict=True)]
                columns = [
                    names.take(pa.array(d)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x.tobytes()) for x in cuts], pa.int64()),
                    pa.array(sizes[d]), pa.array(next_id + s), pa.array(offset),
                ]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cuts).view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
            next_id += len(rooms(int(first[-1]), length))

        for batch in batches(iterator, 10_000, 12 << 20):
            raw, ends = words.encode(batch.column(1))
            # The end token goes in behind each document.
            ids = np.insert(raw, ends, END).astype("<u4")
            sizes = np.diff(ends, prepend=0) + 1
            held.append((batch.column(0), ids, sizes))
            tokens += len(ids)
            if tokens >= block:
                yield from flush()
        if held:
            yield from flush()

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    schema = StructType([rows.schema["_id"]])
    kinds = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    for f in StructType.fromDDL(kinds):
        schema = schema.add(f)
    return rows.mapInArrow(packed, schema).withColumnRenamed("_id", doc_id)


def sequences(pieces: DataFrame, linear: float = LINEAR) -> DataFrame:
    """(sequence_id, ids, lengths, cost): the sequences of ``pack(..., with_ids=True)``.

    ``lengths`` has the tokens of each piece in order, for attention that does not
    cross documents. A sequence is short by contract, so its pieces meet in one row.
    """
    size = F.col("length")
    return pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"), F.sum(size * (F.lit(linear) + size)).alias("cost")
    ).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"), "cost")
