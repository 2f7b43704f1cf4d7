"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint from the hashes of its word shingles. Texts
with equal fingerprints form a class and only classes are compared. The bits are
cut into segments; if two fingerprints differ in at most k bits, some segment
differs in few. Each class looks up, per segment, a small Hamming ball around
its own value in the table of that segment, and full distances are verified.

A pair that differs in one bit of a segment is found from the side that has the
bit cleared: only cleared bits are set when the ball is enumerated, which halves
it. A pair is reported by its first matching segment only, so none comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import batches, byte_texts
from auditlake.llm.components import components
from auditlake.session import materialize

HASH_SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of the word shingles of one text, in order and with repeats; none without words.

    A-Z are lower-cased, words are runs without ASCII blanks, shingles are joined
    by one space; fewer words make one shorter shingle.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    spans = zip(starts[:n].tolist(), stops[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], HASH_SEED) for i, j in spans), np.uint64, n)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned number; 0 without words.

    A bit is set if it is set in over half of the shingle hashes.
    """
    hashes = shingle_hashes(text, shingle).astype(">u8")
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, keys: bool = False) -> DataFrame:
    """(_id, fp) per row; ``fp`` holds the 64 bits as a signed long. With ``keys`` also the two halves of ``row_key``."""

    def hashed(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            found = np.array([fingerprint(t, shingle) for t in byte_texts(batch.column(1))], np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    more = [k.alias(n) for n, k in zip(("k1", "k2"), row_key(F.col(doc_id), F.col(text)), strict=True)] if keys else []
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *more)
    schema = StructType([rows.schema["_id"]]).add("fp", "long")
    for k in rows.columns[2:]:
        schema = schema.add(k, "long")
    return rows.mapInArrow(hashed, schema)


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows with different ids or texts apart."""
    return F.xxhash64(F.lit(1), doc_id, text), F.xxhash64(F.lit(2), doc_id, text)


def segments(bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) per segment for links of up to ``bits`` differing bits.

    With m segments and r = bits // m, the first bits - r * m + 1 segments are
    searched to radius r and the others to r - 1. m is the least above one that
    keeps r at one or below; segments of radius below zero need no search.
    """
    m = max(2, (bits + 2) // 2)
    r = bits // m
    full = bits - r * m + 1
    cuts = [64 * i // m for i in range(m + 1)]
    found = [(cuts[i], cuts[i + 1] - cuts[i], r if i < full else r - 1) for i in range(m)]
    return [s for s in found if s[2] >= 0]


def _part(fp: str | Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long")) if width < 64 else F.col(fp)


def _ball(i: int, low: int, width: int, radius: int) -> Column:
    """The value of a segment and, for radius one, that value with each cleared bit set."""
    part = _part("fp", low, width)
    entry = lambda key, same: F.struct(F.lit(i).alias("segment"), key.alias("key"), F.lit(same).alias("same"))
    same = F.array(entry(part, True))
    if not radius:
        return same
    bits = F.array(*(F.lit(1 << k).cast("long") for k in range(width)))
    cleared = F.filter(bits, lambda bit: part.bitwiseAND(bit) == 0)
    return F.concat(same, F.transform(cleared, lambda bit: entry(part.bitwiseOR(bit), False)))


def linked(classes: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): pairs of different fingerprints that differ in at most ``bits`` bits, each once."""
    cut = segments(bits)
    rows = [
        F.struct(F.lit(i).alias("segment"), _part("fp", low, width).alias("key")) for i, (low, width, _) in enumerate(cut)
    ]
    table = classes.select("fp", F.explode(F.array(*rows)).alias("e")).select("e.segment", "e.key", F.col("fp").alias("b"))
    balls = [_ball(i, *segment) for i, segment in enumerate(cut)]
    probes = classes.select(F.col("fp").alias("a"), F.explode(F.concat(*balls)).alias("e")).select(
        "a", "e.segment", "e.key", "e.same"
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = (apart >= 1) & (apart <= bits) & (~F.col("same") | (F.col("a") < F.col("b")))
    for i, (low, width, radius) in enumerate(cut[:-1]):
        earlier = F.bit_count(_part(F.col("a").bitwiseXOR(F.col("b")), low, width)) <= radius
        near &= ~((F.col("p.segment") > i) & earlier)
    p, t = probes.alias("p"), table.alias("t")
    on = (F.col("p.segment") == F.col("t.segment")) & (F.col("p.key") == F.col("t.key"))
    return p.join(t, on & near).select("a", "b")


def _rooted(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, first, root) per fingerprint of ``rows`` (_id, fp): its smallest id, and the fingerprint that names its component."""
    classes = rows.groupBy("fp").agg(F.min("_id").alias("first"))
    roots = components(linked(classes.select("fp"), bits))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def component_of(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, component_id) per fingerprint of ``rows`` (_id, fp)."""
    rooted = _rooted(rows, bits)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2
) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) per row of ``docs``.

    ``fingerprint`` has 16 lower-case hex digits, ``component_id`` is the smallest
    id reachable by links of at most ``bits`` differing bits, itself included.
    ``kept`` is true for the row with that id. Whole texts are read. Null and
    empty texts have fingerprint zero and link like any other. A null id keeps a
    null id; a component of null ids only has a null ``component_id`` and keeps
    all its rows. Repeated rows give repeated results; an empty table gives none.
    """
    rows = materialize(fingerprints(docs, doc_id, text, shingle))
    return rows.join(component_of(rows, bits), "fp").select(
        F.col("_id").alias(doc_id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that with the smallest id.

    Groups are components of links of at most ``bits`` differing bits; null and
    empty texts are one group. Rows are told apart by id and text: where an id
    stands for several texts, each group that it is the smallest id of keeps one of
    its texts. Of rows that share id and text one stays, and a document without an
    id only where its group has none. Names of other columns do not matter; an
    empty table gives none.
    """
    rows = materialize(fingerprints(docs, doc_id, text, shingle, keys=True))
    roots = _rooted(rows, bits).select("fp", "root")
    chosen = rows.join(roots, "fp").groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "k1", "k2")).alias("c"))
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    kept = chosen.select("c.k1", "c.k2").join(copies, ["k1", "k2"])
    k1, k2 = row_key(F.col(f"row.{doc_id}"), F.col(f"row.{text}"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", k1.alias("k1"), k2.alias("k2"))
    found = whole.join(kept, ["k1", "k2"])
    # Only rows that do have copies are brought together once more.
    one = found.filter("n > 1").groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return found.filter("n = 1").select("row").unionByName(one.select("row")).select("row.*")
