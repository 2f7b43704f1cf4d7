"""Alignment of the tokens of two tokenizers.

Tokens of both sides are byte ranges of the same text. Interval coalescing finds
the groups: all tokens sorted by start, a running maximum of their ends, and a
new group wherever a start reaches it. Within a group every pair of an A and a B
token whose ranges overlap is a link.

How many documents hold a pair of ids linked is counted over the corpus, and
each document's links are looked up in that table. Pairs are gathered per block
of documents first: a block holds each of its pairs once, with the number of its
documents, so a pair that is in every document is one row per block, and
the lookup goes back as one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import arrow_rows, batches, give_back, write_once
from auditlake.llm.vocabularies import BYTE_LEVEL, PIECES, ByteLevel, SentencePieces, loaded

#: Bytes of text in a block of documents, a longer document being a block of its own.
BLOCK_BYTES = 3 << 20
#: Characters of a unit that is encoded together with others.
SHORT = 200
_MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_LINKS = ("pairs_of_unit", "pair_at", "times", "units_of_doc", "unit_step", "unit_times")
#: A space behind one of these parts two units, for a while marked by a character that texts hardly hold.
_BEFORE_CUT, _CUT_MARK = r"([\p{L}\p{N}!-~]) ", "\x00"


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group number per interval, for intervals sorted by start: a group ends where a start reaches the running maximum."""
    if not len(start):
        return np.empty(0, np.int64)
    reach = np.maximum.accumulate(end)
    return np.cumsum(np.concatenate(([0], start[1:] >= reach[:-1])))


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all overlapping pairs; the tokens of a side follow each other."""
    low = np.searchsorted(end_b, start_a, "right")
    n = np.searchsorted(start_b, end_a, "left") - low
    a = np.repeat(np.arange(len(start_a)), n)
    return a, np.arange(len(a)) + np.repeat(low - (np.cumsum(n) - n), n)


class Aligner:
    """Two vocabularies with the byte lengths and the decimal spellings of their ids.

    Both tokenizers begin a token at a single space behind a letter, digit or mark,
    so texts fall apart there into units that no token and no group crosses. The
    distinct units of a block are encoded and aligned once.
    """

    def __init__(self, a: str = BYTE_LEVEL, b: str = PIECES) -> None:
        self.a, self.b = loaded(ByteLevel, a), loaded(SentencePieces, b)
        self.bytes_a, self.bytes_b = (np.array([len(s) for s in v.spelling], np.int64) for v in (self.a, self.b))
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        # Decimals followed by what comes next: A in the group, B in the group, the next group.
        spelled = lambda n, mark: [b"%d%s" % (i, mark) for i in range(n)]
        self.decimals = spelled(self.size_a, b",") + spelled(self.size_a, b"|") + spelled(self.size_b, b",") + spelled(self.size_b, b";")

    def units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the units of all texts in a row as places in that list, and where each text ends."""
        texts = texts.cast(pa.large_string()).fill_null("")
        holding = pc.match_substring(texts, _CUT_MARK)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.if_else(holding, "", texts), _BEFORE_CUT, "\\1" + _CUT_MARK), _CUT_MARK)
        offsets = np.asarray(cut.offsets)
        coded = cut.flatten().dictionary_encode()
        units, at = coded.dictionary.to_pylist(), np.array(coded.indices)
        for i in np.flatnonzero(np.asarray(holding)).tolist():  # a text that holds the mark itself is one unit
            at[offsets[i] - offsets[0]] = len(units)
            units.append(texts[i].as_py())
        ends = offsets[1:] - offsets[0]
        # A space that ends a text parts nothing: it goes back to the unit before it.
        nothing = np.array([not u for u in units], bool)
        tails = ends[(np.diff(ends, prepend=0) > 1) & nothing[at[ends - 1]]] - 1 if len(ends) else ends
        joined: dict[str, int] = {}
        for i in tails.tolist():
            unit = units[at[i - 1]] + " "
            at[i - 1] = joined.setdefault(unit, len(units))
            if at[i - 1] == len(units):
                units.append(unit)
        kept = np.ones(len(at), bool)
        kept[tails] = False
        return units, at[kept], ends - np.searchsorted(tails, ends)

    def _spells(self, vocabulary, ids: np.ndarray, text: str) -> bool:
        return b"".join(map(vocabulary.spelling.__getitem__, ids.tolist())) == text.encode()

    def _together(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Per side the ids of units that end in no blank and the ids per unit; none if they cannot be told apart."""
        text = " ".join(units)
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        out = []
        for vocabulary, sizes, ids in ((self.a, self.bytes_a, self.a.encode_short(" " + text)), (self.b, self.bytes_b, self.b.encode(text))):
            stops = np.cumsum(sizes[ids])
            last = np.searchsorted(stops, ends)
            if not len(stops) or stops[-1] != ends[-1] or (stops[last] != ends).any():
                return None
            # Byte-level tokens spell any text of their length.
            if vocabulary is self.b and not self._spells(vocabulary, ids, " " + text):
                return None
            out.append((ids.astype(np.int64), np.diff(last, prepend=-1)))
        return out

    def encode(self, units: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(order, ((ids, ids per unit) of A and of B), bad): in the new order of the units.

        A unit is bad if it is empty or a side does not spell a space and the unit; it has no ids.
        """
        plain = [i for i, u in enumerate(units) if u and len(u) <= SHORT and not u[-1].isspace()]
        rest = sorted(set(range(len(units))) - set(plain))
        order, found, bad = [], [], []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            if (both := self._together([units[i] for i in some])) is None:
                rest += some
            else:
                order += some
                found.append(both)
                bad += [False] * len(some)
        for i in rest:
            a, b = (self.a.encode(" " + units[i]), self.b.encode(units[i])) if units[i] else (np.empty(0, np.int64),) * 2
            fails = not units[i] or not self._spells(self.a, a, " " + units[i]) or not self._spells(self.b, b, " " + units[i])
            found.append([(x[:0] if fails else x, np.array([0 if fails else len(x)])) for x in (a.astype(np.int64), b.astype(np.int64))])
            order.append(i)
            bad.append(fails)
        none = np.empty(0, np.int64)
        sides = [tuple(np.concatenate([none, *(x[side][k] for x in found)]) for k in (0, 1)) for side in (0, 1)]
        return np.array(order, np.int64), sides, np.array(bad, bool)

    def align(self, texts: pa.Array) -> dict:
        """Alignments of the texts of a block; see ``blocks`` for the fields."""
        units, at, text_ends = self.units(texts)
        order, ((a, n_a), (b, n_b)), bad = self.encode(units)
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        at = place[at]
        doc = np.repeat(np.arange(len(texts)), np.diff(text_ends, prepend=0))
        good = np.ones(len(texts), bool)
        good[doc[bad[at]]] = False
        at, doc = at[good[doc]], doc[good[doc]]

        end_a, end_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        start_a, start_b = end_a - self.bytes_a[a], end_b - self.bytes_b[b]
        # Units stand one behind the other, so no group or link leaves its unit.
        start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
        by_start = np.lexsort((np.arange(len(start)), start))
        group = np.empty(len(start), np.int64)
        group[by_start] = coalesce(start[by_start], end[by_start])
        group_a, group_b = group[: len(a)], group[len(a) :]
        unit_a = np.repeat(np.arange(len(units)), n_a)
        begins_group = np.diff(group_a, prepend=-1) > 0
        at_a, at_b = overlaps(start_a, end_a, start_b, end_b)
        n_of = lambda x: np.bincount(x, minlength=len(units))
        measures = {"n_a": n_a, "n_b": n_b, "n_groups": n_of(unit_a[begins_group]), "n_links": n_of(unit_a[at_a])}

        # (unit, pair) in one number, so one sort gives the distinct pairs of every unit.
        base = self.size_a * self.size_b
        holder, pair, times = _distinct(unit_a[at_a] * base + a[at_a] * self.size_b + b[at_b], base)
        pairs, pair_at = np.unique(pair, return_inverse=True)
        pair_ends = np.searchsorted(holder, np.arange(len(units)), "right")
        # Documents per pair: each document's distinct units, then its distinct pairs.
        one_doc, one_unit, unit_times = _distinct(doc * len(units) + at, max(1, len(units)))
        n = np.diff(pair_ends, prepend=0)[one_unit]
        first = (pair_ends - np.diff(pair_ends, prepend=0))[one_unit]
        listed = pair_at[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        _, held_pair, _ = _distinct(np.repeat(one_doc, n) * max(1, len(pairs)) + listed, max(1, len(pairs)))

        del start, end, by_start, group, at_a, at_b, listed, n, first, holder, pair
        texts_of = self.spelled(a, b, group_a, group_b, np.cumsum(n_a), np.cumsum(n_b))
        ends = np.searchsorted(doc, np.arange(len(texts)), "right")
        whole = at.tolist()
        cuts = zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
        return {
            **{c: np.bincount(doc, weights=x[at], minlength=len(texts)).astype(np.int64) for c, x in measures.items()},
            "groups": [b";".join(map(texts_of.__getitem__, whole[i:j])) for i, j in cuts],
            "pairs": pairs, "held": np.bincount(held_pair, minlength=len(pairs)),
            "pairs_of_unit": np.diff(pair_ends, prepend=0), "pair_at": pair_at, "times": times,
            "units_of_doc": np.bincount(one_doc, minlength=len(texts)), "unit_step": np.diff(one_unit, prepend=0), "unit_times": unit_times,
        }

    def spelled(self, a, b, group_a, group_b, ends_a, ends_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` per unit, empty without tokens."""
        same_a = np.diff(group_a, append=-1) == 0
        same_b = np.diff(group_b, append=-1) == 0
        # An A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own.
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + np.where(same_a, 0, self.size_a)
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * self.size_a + b + np.where(same_b, 0, self.size_b)
        parts = list(map(self.decimals.__getitem__, code.tolist()))
        stops = (ends_a + ends_b).tolist()
        return [b"".join(parts[i:j])[:-1] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


def _distinct(numbers: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in order as (number // base, number % base, times)."""
    numbers = np.sort(numbers)
    begins = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else np.empty(0, np.int64)
    return *np.divmod(numbers[begins], base), np.diff(np.concatenate((begins, [len(numbers)])))


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = BYTE_LEVEL, b: str = PIECES, with_groups: bool = False) -> DataFrame:
    """One row per block of documents.

    ``docs``: the documents with their counts and the digest of their groups (the
    groups themselves on request). ``pairs`` and ``held``: the id pairs linked in
    the block, as A id times the size of B plus B id, with the number of documents.
    ``links``: compressed whole numbers, ``sizes`` tells how many of each kind: per
    unit its number of pairs, these as places in ``pairs``, and how often each is
    linked; per document its number of distinct units, these as steps from one to
    the next, and how often each occurs.
    """

    def read(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(Aligner, a) if b == PIECES else Aligner(a, b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches(iterator, 4000, BLOCK_BYTES):
            got = aligner.align(batch.column(1))
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
            fields = [batch.column(0), *(pa.array(got[c], pa.int64()) for c in _MEASURES), pa.array(digests)]
            if with_groups:
                fields.append(pa.array([g.decode() for g in got["groups"]]))
            listed = pa.StructArray.from_arrays(fields, fields=list(schema.field("docs").type.value_type))
            packed = pa.compress(b"".join(got[c].astype("<i4").tobytes() for c in _LINKS), codec="zstd", asbytes=True)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), one(listed), one(pa.array(got["pairs"], pa.int64())), one(pa.array(got["held"], pa.int64())),
                    one(pa.array([len(got[c]) for c in _LINKS], pa.int32())), pa.array([packed], pa.binary()),
                ],
                schema=schema,
            )
            number += 1
            del got, digests, fields, listed, packed
            give_back()

    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = StructType([rows.schema["_id"]])
    for f in StructType.fromDDL(", ".join(f"{c} long" for c in _MEASURES) + ", groups_sha256 string" + ", groups string" * with_groups):
        kind = kind.add(f)
    out = StructType.fromDDL("block long, pairs array<long>, held array<long>, sizes array<int>, links binary")
    out = StructType([out["block"], StructType().add("docs", _listed(kind))["docs"], *out.fields[1:]])
    schema = to_arrow_schema(out)
    return rows.mapInArrow(read, out)


def _listed(kind: StructType):
    from pyspark.sql.types import ArrayType

    return ArrayType(kind)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, top) from ``blocks``: documents per id pair, and whether that is the most for its A id."""
    counts = found.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("n"))
    # An A id has no more partners than B has ids.
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {size_b}")))
    return counts.select("pair", "n", (F.col("n") == most).alias("top"))


def alignments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = BYTE_LEVEL, b: str = PIECES, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row, and ``groups`` on request.

    Whole texts are encoded, special tokens as plain text; the A side reads a space
    and the text, the B model puts the space itself. A text that is null, empty or
    not spelled back by one of the sides (U+2581 in it, say) has no tokens: zeros
    and an empty digest. A null id stays null. Repeated rows count as documents
    each. An empty table gives none. Columns beside the two named are not looked at.
    """
    with arrow_rows(docs.sparkSession, 1000):
        found = write_once(blocks(docs, doc_id, text, a, b, with_groups), "alignment")
    size_b = len(loaded(SentencePieces, b).spelling)
    table = pair_counts(found, size_b)
    asked = found.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(table, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "n", "top")).alias("told"))
    rows = found.select("block", "docs", "sizes", "links").join(told, "block", "left")

    def summed(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            for i in range(batch.num_rows):
                listed, sizes = batch.column(1)[i].values, np.asarray(batch.column(2)[i].values)
                raw = pa.decompress(batch.column(3)[i].as_buffer(), 4 * int(sizes.sum()), codec="zstd", asbytes=True)
                pairs_of, pair_at, times, units_of, step, unit_times = np.split(np.frombuffer(raw, "<i4").astype(np.int64), np.cumsum(sizes)[:-1])
                best = sums = np.zeros(len(listed), np.int64)
                if len(pair_at):
                    answer = batch.column(4)[i].values
                    place = np.asarray(answer.field("at"))
                    count, top = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
                    count[place] = np.asarray(answer.field("n"))
                    top[place] = np.asarray(answer.field("top").cast(pa.int8()))
                    each = lambda x, n: np.diff(np.concatenate(([0], np.cumsum(x)))[np.cumsum(n)], prepend=0)
                    unit = np.cumsum(step)
                    # From pairs to units, from units to documents.
                    best, sums = (each(unit_times * each(times * x[pair_at], pairs_of)[unit], units_of) for x in (top, count))
                yield pa.RecordBatch.from_arrays([*listed.flatten(), pa.array(best), pa.array(sums)], names)

    kind = StructType([*found.schema["docs"].dataType.elementType.fields]).add("n_best", "long").add("count_sum", "long")
    names = kind.names
    columns = [F.col("_id").alias(doc_id), *_MEASURES, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return rows.mapInArrow(summed, kind).select(*columns)
