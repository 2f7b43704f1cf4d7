"""Quality rules over repetition: characters inside duplicated word n-grams and lines.

Rolling polynomial hashes give every word n-gram of several lengths a 64-bit key
in one numpy pass per length (the key of length n comes from that of n - 1).
Keys found twice mark all words below them; their characters, as a share of all
characters in words, are compared with a limit per length. Lines count likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import batches, byte_texts

BASE_WINDOW = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Percentages of word characters above which a text is rejected."""

    ngrams: dict[int, int] = field(default_factory=lambda: {5: 35, 6: 33, 7: 31, 8: 29, 9: 27, 10: 25})
    lines: int = 40
    #: A repeated line is a weak sign in short texts: the share is taken from this many words on.
    least_words: int = 10


def coverage(text: bytes, lengths: tuple[int, ...]) -> dict[str, int | list[int]]:
    """Counts of one text; ``cover`` has the code points inside duplicated n-grams, by length."""
    raw = np.frombuffer(text, np.uint8)
    blank = _BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    words = text.split()
    out: dict = {"n_words": len(words), "word_chars": int(chars.sum()), "n_symbols": int(_SYMBOL[raw].sum())}
    seen: set[bytes] = set()
    n_dup = dup_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += 1
            dup_chars += sum(len(w) - sum(b & 0xC0 == 0x80 for b in w) for w in line.split())
        elif line.split(None, 1):
            seen.add(line)
    out |= {"n_dup_lines": n_dup, "dup_line_chars": dup_chars, "n_repeat_words": 0, "cover": [0] * len(lengths)}
    if len(words) <= BASE_WINDOW:
        return out
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = ids
    for n in range(2, max(lengths) + 1):
        if n > len(words):
            break
        key = key[:-1] * _BASE + ids[n - 1 :]
        if n not in lengths and n != BASE_WINDOW:
            continue
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        if not len(same):
            continue
        found = np.zeros(len(key), bool)
        found[order[same]] = found[order[same + 1]] = True
        ends_at = np.zeros(len(words) + 1, np.int32)
        ends_at[: len(key)] += found
        ends_at[n : n + len(key)] -= found
        inside = np.cumsum(ends_at[:-1]) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = int(inside.sum())
        if n in lengths:
            out["cover"][lengths.index(n)] = int(chars[inside].sum())
    return out


def repetition_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits | None = None
) -> DataFrame:
    """One row per document: counts, covered characters per n-gram length, and the verdict.

    Whole texts are read; a null text counts as empty. Empty texts and texts under
    ten words fail the base rule. Repeated rows give repeated results, a null id
    stays null, an empty table gives an empty one, other columns are not looked at.
    Texts of ``BASE_WINDOW`` words or fewer hold no second window.

    ``base_failed``: fewer than ten words, or over a fifth of the words in repeated
    five-word windows. ``kept``: neither that, nor a share of characters over a limit.
    """
    limits = limits or Limits()
    lengths = tuple(sorted(limits.ngrams))
    ceilings = [limits.ngrams[n] for n in lengths]
    ints = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")

    def measure(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            found = [coverage(t, lengths) for t in byte_texts(batch.column(1))]
            columns = {"_id": batch.column(0)}
            columns |= {c: pa.array([x[c] for x in found], pa.int64()) for c in ints}
            columns["cover"] = pa.array([x["cover"] for x in found], pa.list_(pa.int64()))
            failed = [x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"] for x in found]
            columns["base_failed"] = pa.array(failed, pa.bool_())
            columns["kept"] = pa.array(
                [
                    not bad
                    and not any(100 * c > top * x["word_chars"] for c, top in zip(x["cover"], ceilings, strict=True))
                    and not (
                        x["n_words"] >= limits.least_words
                        and 100 * x["dup_line_chars"] > limits.lines * x["word_chars"]
                    )
                    for x, bad in zip(found, failed, strict=True)
                ],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_pydict(columns)

    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, " + ", ".join(f"{c} long" for c in ints) + ", cover array<long>, base_failed boolean, kept boolean"
    return chosen.mapInArrow(measure, schema).withColumnRenamed("_id", doc_id)
