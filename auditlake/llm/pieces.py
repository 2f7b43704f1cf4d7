"""SentencePiece encoding and decoding with N-best segmentations.

The text is a lattice of vocabulary pieces. A forward Viterbi pass gives every
position the best score of a path up to it; these scores are exact heuristics
for an A-star search that runs backward from the end, so its first N arrivals at
the start are the N best segmentations, in order.

No piece holds a blank after another character, and hardly any both letters and
marks, so the lattice falls apart into units. The distinct units of a batch of
texts go through the forward pass together, position by position, and the N best
of a text are put together from the N best of those units that lose least, which
is exact as scores add up. Nothing is remembered from batch to batch, so memory
is bounded by the batch and the longest text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import batches, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Characters of units that go through the forward pass together with others, and such characters at a time.
SHORT, TOGETHER = 64, 200_000
#: A byte stands for a character without a piece, at this much below the worst piece.
BYTE_PENALTY = 10.0
#: Scores below this mark pieces that are not for segmentation.
FORBIDDEN = -1e8
_COARSE = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: With more pieces than this across the border of words and marks, texts are cut at blanks only.
MOST_MIXED = 32

_NONE = float("-inf")
_BY_PROMISE = itemgetter(0, 1)
_LOST = itemgetter(0)

Path = tuple[float, tuple[int, ...]]


@dataclass
class Vocabulary:
    """Pieces with scores, read from a model file on the driver and sent to the tasks."""

    pieces: list[str]
    scores: list[float]
    kinds: str  # per id: n normal, b byte, c control, u unknown

    def __post_init__(self) -> None:
        normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == "n"}
        self.ids = {p: (i, self.scores[i]) for p, i in normal.items()}
        # Marks: line ends, ASCII marks, and other marks that share a piece with one. Texts that
        # hold one of the few pieces across the border of words and marks are cut at blanks only.
        self.marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n")
        bare = [p.strip(BLANK) for p in normal]
        while more := {c for p in bare if self.marks & set(p) for c in p if not c.isalnum() and c != BLANK} - self.marks:
            self.marks |= more
        mixed = [p for p in bare if 0 < sum(c in self.marks for c in p) < len(p)]
        self.mixed = None if len(mixed) > MOST_MIXED else mixed
        mark = "".join(map(re.escape, sorted(self.marks)))
        self.fine = re.compile(f"{BLANK}*[^{mark}{BLANK}]+|{BLANK}*[{mark}]+|{BLANK}+")
        self.classes = np.ones(0x110000, np.int8)  # of a character: 0 blank, 1 of words, 2 mark
        self.classes[[ord(c) for c in self.marks]] = 2
        self.classes[ord(BLANK)] = 0
        self.characters = frozenset(p for p in normal if len(p) == 1)
        self._grow_tree()
        self.matcher = ahocorasick.Automaton()
        for piece, (i, score) in self.ids.items():
            self.matcher.add_word(piece, ((i,), score, len(piece)))
        self.matcher.make_automaton()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == "b"}
        self.unknown = self.kinds.find("u")
        self.floor = min((s for s in self.scores if s > FORBIDDEN), default=0.0) - BYTE_PENALTY
        self.parts = [
            bytes([int(p[3:5], 16)]) if k == "b" else b"" if k == "c" else " ⁇ ".encode() if k == "u" else p.replace(BLANK, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self.spelled = pa.array(self.parts, pa.large_binary())

    def _grow_tree(self) -> None:
        """The prefixes of all pieces as nodes of a tree; from a node by a character to a node, as a sorted table."""
        children: dict[int, int] = {}
        self.piece_at = [-1]
        for piece, (i, _) in self.ids.items():
            node = 0
            for c in piece:
                step = node << 21 | ord(c)
                if (node := children.get(step, -1)) < 0:
                    node = children[step] = len(self.piece_at)
                    self.piece_at.append(-1)
            self.piece_at[node] = i
        self.piece_at = np.array(self.piece_at, np.int32)
        steps = np.array(sorted(children), np.int64)
        self.steps, self.nodes = steps, np.array([children[x] for x in steps.tolist()], np.int32)
        self.first_step = np.full(0x110000, -1, np.int32)
        from_root = np.array([x for x in steps.tolist() if x < 1 << 21], np.int64)
        self.first_step[from_root] = self.nodes[: len(from_root)]
        self.score_of = np.array(self.scores)

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "scores": self.scores, "kinds": self.kinds}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = "".join("u" if model.is_unknown(i) else "c" if model.is_control(i) else "b" if model.is_byte(i) else "n" for i in ids)
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)

    def units(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses, the model's blank put before the first."""
        if not text:
            return []
        rule = _COARSE if self.mixed is None or any(m in text for m in self.mixed) else self.fine
        return rule.findall(BLANK + text.replace(" ", BLANK))

    def matches(self, word: str) -> Iterator[tuple[int, int, float, tuple[int, ...]]]:
        """The pieces in a word as (end, start, score, ids), in order of their ends."""
        if self.characters.issuperset(word):
            return ((last + 1, last + 1 - n, score, ids) for last, (ids, score, n) in self.matcher.iter(word))
        found = [(last + 1, last + 1 - n, score, ids) for last, (ids, score, n) in self.matcher.iter(word)]
        for i, c in enumerate(word):
            if c not in self.characters:
                raw = c.encode("utf-8", "surrogatepass")
                fallback = tuple(self.bytes[b] for b in raw) if self.bytes else (self.unknown,)
                found.append((i + 1, i, self.floor * len(fallback), fallback))
        return iter(sorted(found))

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Per end position the pieces that end there: (start, score, ids)."""
        ends: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        for j, i, score, ids in self.matches(word):
            ends[j].append((i, score, ids))
        return ends

    def best(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """Best score, its ids, and what the second-best segmentation loses (infinite if there is none).

        Forward Viterbi with the two best scores of every position.
        """
        n = len(word)
        first, second = [0.0] + [_NONE] * n, [_NONE] * (n + 1)
        came: list = [None] * (n + 1)
        # The matcher reports pieces in order of their ends, so what comes before an end is settled.
        for j, i, score, ids in self.matches(word):
            x, y = first[i] + score, second[i] + score
            if x > first[j]:
                first[j], y = x, max(first[j], y)
                came[j] = i, ids
            else:
                y = max(x, y)
            if y > second[j]:
                second[j] = y
        steps: list[tuple[int, ...]] = []
        while n:
            n, ids = came[n]
            steps.append(ids)
        return first[-1], tuple(chain.from_iterable(reversed(steps))), first[-1] - second[-1]

    def n_best(self, word: str, n: int) -> list[Path]:
        """The ``n`` best segmentations of one word, best first; among ties those that got nearer to the start.

        An entry is a path from the end, kept as a link to its first piece and the
        rest. What its score and the exact heuristic promise is the score of a
        segmentation, and no two entries share one, so no more entries are kept
        than segmentations are still to be found.
        """
        ends = self.edges(word)
        ahead = [0.0] + [_NONE] * len(word)  # forward Viterbi
        for j in range(1, len(word) + 1):
            ahead[j] = max((ahead[i] + s for i, s, _ in ends[j]), default=_NONE)
        front: list[tuple[float, int, float, tuple | None]] = [(-ahead[-1], len(word), 0.0, None)]
        found: list[Path] = []
        while front and len(found) < n:
            _, at, score, link = front.pop(0)
            if at == 0:
                tail: list[int] = []
                while link:
                    ids, link = link
                    tail += ids
                found.append((score, tuple(tail)))
                continue
            front += [(-(ahead[i] + s + score), i, s + score, (ids, link)) for i, s, ids in ends[at]]
            if len(front) > 1:
                front.sort(key=_BY_PROMISE)
                del front[n - len(found) :]
        return found

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``units`` of many texts: the distinct ones, all in a row as places among these, and where each text ends."""
        ready = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        whole = "".join(ready)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(points):
            return [], np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.classes[points]
        stops = np.cumsum([len(t) for t in ready])
        for t, stop in zip(ready, stops.tolist(), strict=True):
            if self.mixed is None or any(m in t for m in self.mixed):  # cut at blanks only
                np.minimum(kind[stop - len(t) : stop], 1, out=kind[stop - len(t) : stop])
        blank, before = kind == 0, np.concatenate(([0], kind[:-1]))
        starts = (before != 0) & (blank | (kind != before))
        starts[np.concatenate(([0], stops[:-1]))[stops > np.concatenate(([0], stops[:-1]))]] = True
        at = np.flatnonzero(starts)
        raw = whole.encode()
        size = np.ones(len(points), np.int8)
        for limit in (0x7F, 0x7FF, 0xFFFF):  # bytes of a character in UTF-8
            size += points > limit
        begin = np.cumsum(size, dtype=np.int64)
        offsets = pa.py_buffer(np.append(begin[at] - size[at], len(raw)))
        coded = pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(raw)).dictionary_encode()
        return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), np.searchsorted(at, stops)

    def best_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of many units: scores, losses, and ids in a row with the place of the first and the number per unit."""
        scores, losses = np.zeros(len(units)), np.zeros(len(units))
        first, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        flat, filled = [np.empty(0, np.int32)], 0
        short: list[int] = []
        for i, u in enumerate(units):
            if len(u) <= SHORT and self.characters.issuperset(u):
                short.append(i)
            else:
                scores[i], found, losses[i] = self.best(u)
                first[i], size[i] = filled, len(found)
                flat.append(np.array(found, np.int32))
                filled += len(found)
        start, total = 0, 0
        for k, i in enumerate(short):
            total += len(units[i])
            if total >= TOGETHER or k + 1 == len(short):
                some = short[start : k + 1]
                scores[some], losses[some], found, many = self._together([units[x] for x in some])
                first[some], size[some] = filled + np.cumsum(many) - many, many
                flat.append(found)
                filled += len(found)
                start, total = k + 1, 0
        return scores, losses, np.concatenate(flat), first, size

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, losses, ids in a row and their number per unit: forward Viterbi with the two best scores of every position, for units side by side.

        Pieces are found by walking the tree from all places at once. Then all
        pieces that end at the first character of their unit are looked at, those
        that end at the second, and so on; the longest first, as in ``best``.
        """
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(u) for u in units], np.int64)
        stop = np.cumsum(size)
        left = np.repeat(stop, size) - np.arange(len(points))  # characters to the end of the unit
        inside = np.repeat(size, size) - left
        place = np.arange(len(points))
        node = self.first_step[points]
        begin, length, piece = [], [], []
        depth = 1
        while len(place):
            found = self.piece_at[node]
            hit = found >= 0
            begin.append(place[hit])
            piece.append(found[hit])
            length.append(np.full(len(begin[-1]), depth, np.int64))
            on = left[place] > depth
            place, node = place[on], node[on].astype(np.int64)
            step = node << 21 | points[place + depth]
            spot = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            on = self.steps[spot] == step
            place, node = place[on], self.nodes[spot[on]]
            depth += 1
        begin, length, piece = np.concatenate(begin), np.concatenate(length), np.concatenate(piece)
        wave = (inside[begin] + length) * (depth + 1) + depth - length
        order = np.argsort(wave.astype(np.uint16), kind="stable")
        begin, length, piece, wave = begin[order], length[order], piece[order], wave[order]
        # Every unit has one place more than characters.
        own = np.repeat(np.arange(len(units)), size)
        source = begin + own[begin]
        target = source + length
        zero = stop - size + np.arange(len(units))
        first, second = np.full(len(points) + len(units), _NONE), np.full(len(points) + len(units), _NONE)
        came = np.zeros(len(first), np.int64)
        first[zero] = 0.0
        gain = self.score_of[piece]
        cuts = np.flatnonzero(np.diff(wave, prepend=-1, append=-1))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, t, g = source[i:j], target[i:j], gain[i:j]
            x, y, old = first[s] + g, second[s] + g, first[t]
            better = x > old
            second[t] = np.maximum(second[t], np.maximum(np.where(better, old, x), y))
            first[t] = np.where(better, x, old)
            came[t[better]] = np.arange(i, j)[better]
        end = zero + size
        # Back from the ends, one piece of every unit at a time.
        at, who, steps = end.copy(), np.arange(len(units)), []
        while len(who):
            edge = came[at]
            steps.append((who, piece[edge]))
            at = source[edge]
            on = at > zero[who]
            at, who = at[on], who[on]
        many = np.zeros(len(units), np.int64)
        for who, _ in steps:
            many[who] += 1
        ends = np.cumsum(many)
        flat = np.empty(ends[-1], np.int32)
        for k, (who, p) in enumerate(steps):
            flat[ends[who] - 1 - k] = p
        return first[end], first[end] - second[end], flat, many

    def encode_all(self, texts: list[str], n: int = 1) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, dict[int, Path]]]]]:
        """(ids of all texts in a row, where each text ends, per text the n best as (score, {unit: its other path})).

        A unit that takes another path loses at least its second path, so the n best
        differ from the best in the n - 1 units that lose least by that, at most.
        Only these units are searched for their n best.
        """
        units, at, ends = self.cut(texts)
        scores, losses, flat, first, size = self.best_of(units)
        here = size[at]
        stops = np.concatenate(([0], np.cumsum(here)))
        spelled = flat[np.repeat(first[at] - stops[:-1], here) + np.arange(stops[-1])]
        least = self._least(losses[at], ends, n - 1)
        known: dict[int, list[Path]] = {}
        ranked = []
        for k, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            total = float(np.cumsum(scores[at[i:j]])[-1]) if j > i else 0.0
            combined: list[tuple[float, dict[int, Path]]] = [(0.0, {})]
            for w in least[k]:
                u = at[w]
                if u not in known:
                    paths, taken = self.n_best(units[u], n), tuple(flat[first[u] : first[u] + size[u]].tolist())
                    # Among ties the path taken above goes first.
                    known[u] = [(paths[0][0], taken), *[p for p in paths if p[1] != taken]][:n]
                paths = known[u]
                combined = heapq.nsmallest(
                    n,
                    [(lost + paths[0][0] - p[0], {**picks, int(w) - i: p} if c else picks) for lost, picks in combined for c, p in enumerate(paths)],
                    key=_LOST,
                )
            ranked.append([(total - lost, picks) for lost, picks in combined])
        return spelled, stops[ends], ranked

    @staticmethod
    def _least(losses: np.ndarray, ends: np.ndarray, n: int) -> list[list[int]]:
        """Per text the places of its n smallest finite losses, the smallest first, among ties the first."""
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        out: list[list[int]] = [[] for _ in ends]
        full = np.flatnonzero(ends > starts)
        if not len(full):
            return out
        losses, own = losses.copy(), np.repeat(np.arange(len(ends)), ends - starts)
        for _ in range(n):
            low = np.full(len(ends), np.inf)
            low[full] = np.minimum.reduceat(losses, starts[full])
            spots = np.flatnonzero((losses == low[own]) & np.isfinite(losses))
            spot = np.full(len(ends), -1)
            spot[own[spots][::-1]] = spots[::-1]
            for k in np.flatnonzero(spot >= 0).tolist():
                out[k].append(int(spot[k]))
            losses[spot[spot >= 0]] = np.inf
        return out

    def encode(self, text: str, n: int = 1) -> tuple[list[int], list[tuple[float, dict[int, Path]]]]:
        """Best ids of one text, and its n best; see ``encode_all``."""
        ids, _, ranked = self.encode_all([text], n)
        return ids.tolist(), ranked[0]

    def spell(self, text: str, picks: dict[int, Path]) -> list[int]:
        """The ids of one of the n best of a text."""
        units = self.units(text)
        return [i for w, u in enumerate(units) for i in (picks[w][1] if w in picks else self.best(u)[1])]

    def decode(self, ids: list[int]) -> str:
        """The text of a piece sequence. Bytes that form no character are replaced, the first blank goes."""
        return _text(b"".join([self.parts[i] for i in ids]))

    def decode_all(self, lists: pa.ListArray) -> list[str | None]:
        """``decode`` of a column of sequences; null stays null."""
        spelled = self.spelled.take(lists.flatten())
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[: len(spelled) + 1]
        raw = memoryview(spelled.buffers()[2] or b"")
        # Null lists hold nothing of what ``flatten`` gives.
        stops = ends[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))].tolist()
        there = lists.is_valid().to_pylist()
        return [_text(bytes(raw[i:j])) if ok else None for ok, i, j in zip(there, stops[:-1], stops[1:], strict=True)]


def _text(raw: bytes) -> str:
    out = raw.decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def encode(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_best: int = 4, model: str = MODEL, alternatives: bool = False
) -> DataFrame:
    """(doc_id, ids, ids_crc32, scores, text_hash) per document.

    ``ids`` is the best segmentation of the whole text, ``scores`` has those of the
    ``n_best`` best, fewer where the text has fewer. With ``alternatives`` a column
    ``paths`` holds the ids of all of them. Null and empty texts have no pieces and
    one score of zero. Repeated rows give repeated results, an empty table gives
    none. ``text_hash`` is xxhash64 of the text, to check a decoding by. The
    character U+2581 is the model's blank and decodes to a space.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def encoded(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches(iterator, 4000, 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends, ranked = vocabulary.encode_all(texts, n_best)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            raw = ids.astype("<i4")
            crcs = [zlib.crc32(raw[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [
                batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids)),
                pa.array(crcs, pa.int64()), pa.array([[s for s, _ in r] for r in ranked], pa.list_(pa.float64())), batch.column(2),
            ]
            if alternatives:
                paths = [[vocabulary.spell(t, picks) for _, picks in r] for t, r in zip(texts, ranked, strict=True)]
                columns.append(pa.array(paths, pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            del texts, ids, ends, ranked, raw, columns
            give_back()

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    schema = StructType([rows.schema["_id"]])
    extra = "ids array<int>, ids_crc32 long, scores array<double>, text_hash long" + ", paths array<array<int>>" * alternatives
    for f in StructType.fromDDL(extra):
        schema = schema.add(f)
    return rows.mapInArrow(encoded, schema).withColumnRenamed("_id", doc_id)


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with the column ``ids`` replaced by ``text``; null ids give a null text, no ids an empty one.

    Repeated rows give repeated results, an empty table gives none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    at = rows.columns.index(ids)

    def decoded(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 500, 4 << 20):
            texts = shared.value.decode_all(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], out.names
            )

    out = StructType()
    for i, f in enumerate(rows.schema):
        out = out.add("text", "string") if i == at else out.add(f)
    return rows.mapInArrow(decoded, out)
