"""Alignment, packing and the filter audit against definitions and brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlake.llm import alignment, packing, survival, vocabularies
from auditlake.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "word " * 12, None, "a", 5), (3, " \n\t ", "de", "b", 4),
    (4, "ñ日本 x y " * 30, "fr", "b", 9), (4, "ñ日本 x y " * 30, "fr", "b", 9), (5, "long words here " * 20_000, "en", "a", 1),
    (6, "x" * 30_000, "en", "a", 1), (7, "a ▁ b", "en", None, 1), (8, "<|endoftext|> <s> <0x41> <|startoftext|>a", "en", "", 1), (9, " " * 5000 + "a", "x", "y", 0),
]
STRANGE = ["it's I'LL 'd x's", "é é ́x ﬁ İ ΑΣ Σ", "a b c\x1cd\x85e\x0bf\x0cg", "1234 ½ ٣ 12a3", "!!! ... ?!a,b", "日本語 한국 𝒳𝒴 👩‍👩‍👧", "​‍﻿", "ᄀ ᅡ ᆨ", 'a.b è, É! x") I\u0307 A\u0301. \u212a? …. a\u0338; <\u0338 q=.', "a<|endoftext|>b"]


@pytest.fixture
def odd(frame):
    """Nulls, blanks, a repeated row, long texts, and columns named like results."""
    clash = ("_id", "_text", "part", "failed", "digest", "good", "toxic", "first", "block", "docs", "ids", "sequence_id", "length")
    return frame(DOCS, ODD).withColumns({c: F.lit("z") for c in clash})


def _noise(n, seed):
    rng = np.random.default_rng(seed)
    alphabet = list("abcdeABC  \n\t'.,!#12é日Σ́ \x0b\x1c") + ["<|endoftext|>", " the ", "ing"]
    return ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(n)]


def test_units_are_what_no_token_crosses():
    aligner = alignment.Aligner()
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(["the", " ", " a", "\n", "  ", "don't", "é", "12", " x", ".", "\t ", "\x00"], 300)) for _ in range(30)]
    texts = [*texts, *_noise(200, 7), *STRANGE, "", " ", "x" * 5000 + " b", "a" + " " * 900 + "b", "tail ", " head"]
    units, at, ends = aligner.units(pa.array(texts))
    order, sides, bad = aligner.encode(units)
    assert sorted(order.tolist()) == list(range(len(units))) and len(units) > 200
    stops = [np.cumsum(n) for _, n in sides]
    place = {u: i for i, u in enumerate(order.tolist())}
    for t, i, j in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert " ".join(units[u] for u in at[i:j]) == t
        if not t:
            assert all(bad[place[u]] for u in at[i:j])
            continue
        for side, (ids, n), vocabulary, text in zip((0, 1), sides, (aligner.a, aligner.b), (" " + t, t), strict=True):
            got = [x for u in at[i:j] for x in ids[stops[side][place[u]] - n[place[u]] : stops[side][place[u]]].tolist()]
            assert any(bad[place[u]] for u in at[i:j]) or got == vocabulary.encode(text).tolist()


def test_fast_and_remembered_ids_are_the_files_ids():
    a, w = vocabularies.ByteLevel(), vocabularies.WordLevel()
    plain = Tokenizer.from_file(vocabularies.WORD_LEVEL)
    texts = [*STRANGE, *_noise(400, 2), "", " ", "x" * 3000, "ab " * 3000]
    for t in texts:
        assert a.encode(t).tolist() == a.exact.encode(t, add_special_tokens=False).ids
        assert b"".join(a.spelling[i] for i in a.encode(t)) == t.encode()
    # With special tokens and without, the second time from memory.
    for texts in [texts, texts, [t for t in texts if "<|" not in t], [t for t in texts if "<|" not in t]]:
        column = pa.array([None, *texts, None], pa.string())
        ids, ends = w.encode(column)
        got = [ids[i:j].tolist() for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        assert got == [[], *(plain.encode(t, add_special_tokens=False).ids for t in texts), []]
    sliced, ends = w.encode(pa.array(texts, pa.string()).slice(3, 4))
    assert len(ends) == 4 and ends[-1] == len(sliced)


def _align(text, a, b):
    """Groups by the definition: cut where both sides end; links by overlapping ranges."""
    if not text:
        return None
    ids_a = a.exact.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.model.encode(text)
    raw = (" " + text).encode()
    if any(b"".join(v.spelling[i] for i in ids) != raw for v, ids in ((a, ids_a), (b, ids_b))):
        return None
    end_a, end_b = (list(itertools.accumulate(len(v.spelling[i]) for i in ids)) for v, ids in ((a, ids_a), (b, ids_b)))
    cuts = sorted(set(end_a) & set(end_b))
    groups, i, j = [], 0, 0
    for c in cuts:
        k, m = end_a.index(c) + 1, end_b.index(c) + 1
        groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
        i, j = k, m
    links = [
        (x, y) for x, p, q in zip(ids_a, [0, *end_a], end_a) for y, r, s in zip(ids_b, [0, *end_b], end_b) if p < s and r < q
    ]
    return len(ids_a), len(ids_b), ";".join(groups), links


def test_alignment_against_brute_force(frame):
    a, b = vocabularies.ByteLevel(), vocabularies.SentencePieces()
    texts = [*STRANGE, *_noise(60, 5), *(t for _, t, *_ in ODD if t is None or len(t) < 1000), "the the the", "the"]
    docs = frame(DOCS, [(i, t, None, None, 0) for i, t in enumerate(texts)]).repartition(3)
    want = [_align(t, a, b) for t in texts]
    held = Counter(p for w in want if w for p in set(w[3]))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    rows = alignment.alignments(docs, with_groups=True).collect()
    assert len(rows) == len(texts) and sum(w is None for w in want) >= 3
    for r in rows:
        if (w := want[r.doc_id]) is None:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) == (0, 0, 0, 0, 0, 0, "", "")
            continue
        assert (r.n_a, r.n_b, r.groups, r.n_links) == (w[0], w[1], w[2], len(w[3]))
        assert r.n_groups == w[2].count(";") + 1 and r.groups_sha256 == hashlib.sha256(w[2].encode()).hexdigest()
        assert r.n_best == sum(held[p] == most[p[0]] for p in w[3]) and r.count_sum == sum(held[p] for p in w[3])


def test_alignment_of_odd_rows(odd, frame):
    rows = alignment.alignments(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].n_a == 0 and by_id[i].groups_sha256 == "" for i in (1, 2, 7))
    assert by_id[5].n_groups >= 60_000 and by_id[8].n_links > 0 and by_id[None].n_a > 12 and by_id[6].n_a > 1000
    assert sorted(r.count_sum for r in rows if r.doc_id == 4) == [by_id[4].count_sum] * 2
    assert alignment.alignments(frame(DOCS, [])).count() == 0


def test_intervals():
    assert alignment.coalesce(np.array([0, 0, 2, 3, 5]), np.array([2, 3, 3, 5, 6])).tolist() == [0, 0, 0, 1, 2]
    assert alignment.coalesce(np.array([], int), np.array([], int)).tolist() == []


@pytest.mark.parametrize("seed", range(6))
def test_assignment_fills_rooms_and_balances(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(0.004, 600), 9000).tolist() + [1] * 30 + [50_000] * (seed % 2)
    placed = packing.assign(sizes, 256)
    room = packing.rooms(sum(sizes), 256)
    assert sum(room) == sum(sizes) and all(r == 256 or (r & (r - 1)) == 0 for r in room)
    for d, n in enumerate(sizes):
        cuts = sorted((s, k) for x, s, k, *_ in placed if x == d)
        assert [s for s, _ in cuts] == list(itertools.accumulate([0, *(k for _, k in cuts)]))[:-1] and sum(k for _, k in cuts) == n
    for s, r in enumerate(room):
        cuts = sorted((o, k) for *_, k, x, o in placed if x == s)
        assert [o for o, _ in cuts] == list(itertools.accumulate([0, *(k for _, k in cuts)]))[:-1] and sum(k for _, k in cuts) == r


def test_costs_are_more_even_than_in_order_of_arrival():
    rng = np.random.default_rng(3)
    sizes = np.concatenate((rng.integers(1, 40, 4000), rng.integers(400, 1500, 200))).tolist()
    cost = np.zeros(len(packing.rooms(sum(sizes))))
    for *_, n, s, _ in packing.assign(sizes):
        cost[s] += n * (packing.LINEAR + n)
    line, naive = [(n, i) for i, n in enumerate(sizes)], [0.0]
    at = 0
    for n, _ in line:
        while n:
            k = min(n, 2048 - at)
            naive[-1] += k * (packing.LINEAR + k)
            at, n = (at + k) % 2048, n - k
            if at == 0:
                naive.append(0.0)
    full = len(cost) - sum(r < 2048 for r in packing.rooms(sum(sizes)))
    assert cost[:full].std() < 0.5 * np.array(naive[:full]).std()


def _check_pieces(rows, texts, length=2048):
    """Every id in one piece, digests right, sequences gapless and short only at powers of two."""
    plain = Tokenizer.from_file(vocabularies.WORD_LEVEL)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts.values()]
    ids = dict(zip(texts, want, strict=True))
    per_doc, per_sequence = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length >= 1
        cut = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(cut) == r.length and r.ids_crc32 == zlib.crc32(cut.tobytes())
        per_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(per_doc) == set(texts)
    gapless = lambda x: [s for s, _ in sorted(x)] == list(itertools.accumulate([0, *(n for _, n in sorted(x))]))[:-1]
    assert all(gapless(x) and sum(n for _, n in x) == len(ids[d]) for d, x in per_doc.items())
    for x in per_sequence.values():
        n = sum(k for _, k in x)
        assert gapless(x) and n <= length and (n == length or n & (n - 1) == 0)


def test_packing_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    _check_pieces(Q.REG.queries["op12_packing"](spark, sf_dir).collect(), texts)


def test_packing_odd_rows(odd, frame):
    out = packing.pack(odd, block=3000, with_ids=True)
    rows = out.collect()
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows) and sum(r.start == 0 for r in rows) == len(ODD)
    assert [r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert all(list(r.ids)[-1] == 1 for r in rows if r.start + r.length == r.doc_tokens)
    whole = packing.sequences(out).collect()
    assert all(sum(s.lengths) == len(s.ids) <= 2048 for s in whole) and sum(len(s.ids) for s in whole) == sum(r.length for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(odd, block=3000, with_ids=True).collect()))
    assert packing.pack(frame(DOCS, [])).count() == 0


def test_popcounts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 16, 1000, 4097):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert survival.popcounts(words).tolist() == [int((words >> b & 1).sum()) for b in range(32)]


def _fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def _audit(rows, good, toxic):
    """Every order run filter by filter."""
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = [(i, s or "", {**_fails(t or ""), "E": i is not None and i > smallest[t or ""]}) for i, t, _, s, _ in rows]
    out = {}
    for part in {p for _, p, _ in docs}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in docs if p == part]
            gone = []
            for step, k in enumerate(order, 1):
                lost = [(i, f) for i, f in left if f[k]]
                out[part, order, step] = [
                    len(left) - len(lost), len(lost), sum(f[k] for _, f in gone), sum(f[k] and sum(f.values()) == 1 for _, p, f in docs if p == part),
                    sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost),
                ]
                left, gone = [x for x in left if not x[1][k]], gone + lost
                shapley[k] += len(lost)
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def test_audit_against_every_order(odd, frame):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#", "y", "é"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(30, 90)))), "en", ["p", "q", "", None][i % 4], 0) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1], "en", "p", 0) for i in range(40)] + [(3, rows[3][1], "en", None, 0)] * 2 + ODD + [(None, rows[1][1], None, "q", 1)]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 230, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    docs = frame(DOCS, rows).withColumns({c: F.lit("z") for c in ("part", "failed", "digest", "good", "toxic", "first", "n")})
    got = survival.audit(docs.repartition(4), frame("doc_id long, quality int, toxic int", labels)).collect()
    want = _audit(rows, {i for i, g, _ in labels if g == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    assert len(got) == len(want) == 600 * len({s or "" for *_, s, _ in rows})
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want
    assert survival.audit(frame(DOCS, []), frame("doc_id long, quality int, toxic int", labels)).count() == 0
    assert survival.audit(odd, frame("doc_id long, quality int, toxic int", [])).agg(F.sum("good_lost")).first()[0] == 0
