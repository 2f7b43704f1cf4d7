"""Toxicity, quality, repetition, pieces and SimHash on small frames and against brute force."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auditlake.llm import pieces, quality, repetition, simhash, toxicity
from auditlake.llm import queries as Q
from auditlake.llm.common import labelled_sample
from auditlake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "word " * 12, None, "a", 5), (3, " \n\t ", "de", "b", 4),
    (4, "ñ日本 x y " * 30, "fr", "b", 9), (4, "ñ日本 x y " * 30, "fr", "b", 9), (5, "long " * 60_000, "en", "a", 1),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def odd(frame):
    """Nulls, blanks, a repeated row, a very long text, and columns named like results."""
    return frame(DOCS, ODD).withColumns({"score": F.lit("x"), "_id": F.lit(7), "fp": F.lit(1), "kept": F.lit("y"), "y": F.lit(2)})


def test_repetition_counts(odd, frame):
    rows = repetition.repetition_rules(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[3].n_words == 0 and by_id[3].n_dup_lines == 0
    assert by_id[5].n_repeat_words == 60_000 and by_id[5].cover == [4 * 60_000] * 6
    assert repetition.repetition_rules(frame(DOCS, [])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_repetition_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(["ab", "ç", "日x", " ", " ", "\n", " ", "#", "\t"], 400))
    words, lengths = WORD.findall(text), (5, 6, 10)
    got = repetition.coverage(text.encode(), lengths)
    for n, cover in zip(lengths, got["cover"], strict=True):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)}
        assert cover == sum(len(words[i]) for i in inside)
        if n == 5:
            assert got["n_repeat_words"] == len(inside)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    assert got["n_dup_lines"] == len(lines) - len(set(lines))
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")


def test_isotonic_is_monotone_and_pools():
    xs, ys = quality.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 0, 1.0]))
    assert list(ys) == sorted(ys) and xs[0] == 0.1 and ys[-1] == 1
    assert np.interp(0.2, xs, ys) == np.interp(0.3, xs, ys) == pytest.approx(1 / 3)


def test_quality_and_toxicity_on_held_out_rows(spark):
    """The small tables have few labels; what matters is that unseen rows come out right."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for key, label, least in (("op5_quality_classifier", "quality", 0.97), ("op2_toxicity", "toxic", 0.95)):
        rows = Q.REG.queries[key](spark, sf).join(labels, "doc_id").filter("held_out").select(label, "predicted", "score").collect()
        assert len(rows) > 500 and all(0 <= r.score <= 1 for r in rows)
        assert sum(r[label] == r.predicted for r in rows) / len(rows) >= least


def test_kernel_ridge_against_plain_algebra(spark, sf_dir):
    """The sums of all tasks, the map and the calibration, recomputed from the sampled rows in one place."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = labelled_sample(docs, labels, "quality", "doc_id", "text", quality.SAMPLE, 17).collect()
    x, y = np.array([quality.statistics(r.text.encode()) for r in rows]), np.array([r.y for r in rows], float)
    unseen = np.array([r.part == 0 for r in rows])
    assert len(rows) > 150 and 0 < unseen.sum() < len(rows)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 0, x.std(0), 1.0))
    scaled = np.clip((x - x.mean(0)) / model.scale, -8, 8)
    z = model.lift(x)
    distance = ((scaled[:, None, :] - scaled[None, :, :]) ** 2).sum(-1)
    assert np.abs(z[:, :-1] @ z[:, :-1].T - np.exp(-distance / quality.N_FEATURES)).mean() < 0.08
    a, n = z[~unseen], int((~unseen).sum())
    penalty = 1e-3 * n * np.diag([1 / z.shape[1]] * (z.shape[1] - 1) + [1e-9])
    assert np.allclose(model.weights, np.linalg.solve(a.T @ a + penalty, a.T @ y[~unseen]), rtol=1e-4, atol=1e-6)
    raw, seen = model.raw(x[unseen]), y[unseen]
    order = np.argsort(raw, kind="stable")
    raw, seen = raw[order], seen[order]
    for i in range(0, len(raw), 7):  # the isotonic fit as the largest of the smallest means
        best = max(min(seen[lo : hi + 1].mean() for hi in range(i, len(raw))) for lo in range(i + 1))
        assert np.interp(raw[i], *model.steps) == pytest.approx(best, abs=1e-9)


def test_classifiers_take_odd_rows(odd, frame):
    texts = ["idiot you fool here", "a fine day it is", "the idiot said nothing", "good words on a walk"] * 40
    docs = frame(DOCS, [(i, f"{t} {i}", "en", "s", 1) for i, t in enumerate(texts)])
    labels = frame("doc_id long, quality int, toxic int", [(i, int(i % 3 > 0), int("idiot" in t)) for i, t in enumerate(texts)] + [(None, 1, 1), (3, None, None)])
    grammar, model = toxicity.fit(docs, labels), quality.fit(docs, labels)
    assert "idiot" in grammar.words
    for scored in (toxicity.score(odd, grammar), quality.score(odd, model)):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    empty = frame("doc_id long, quality int, toxic int", [])
    blank = quality.fit(docs, empty)
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}
    assert toxicity.fit(docs, empty).words == {}
    assert quality.score(frame(DOCS, []), model).count() == 0 and toxicity.score(frame(DOCS, []), grammar).count() == 0
    wide = quality.score(odd, model, keep=True)
    assert wide.columns == [*odd.columns, "_score"] and wide.count() == len(ODD)
    again = quality.score(wide, quality.fit(docs, empty), keep=True)
    assert again.columns == [*wide.columns, "_score_"] and {r["_score_"] for r in again.collect()} == {0.5}


def test_held_out_rows_teach_nothing(frame):
    texts = {i: f"scum {i}" if zlib.crc32(str(i).encode()) % 4 == 2 else f"plain {i}" for i in range(200)}
    docs = frame(DOCS, [(i, t, "en", "s", 1) for i, t in texts.items()])
    labels = frame("doc_id long, toxic int", [(i, int("scum" in t)) for i, t in texts.items()])
    assert toxicity.fit(docs, labels).words == {}


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 5.0}, {"moro": 4.0}, dict(toxicity.PRIOR), -3.0)
    kinds = lambda t: [k for k, _ in g.clauses(t)]
    assert kinds("You are an idiot.") == ["insult at target"]
    assert kinds("What a moronic day") == ["insult"]
    assert kinds("He is not an idiot, is he") == ["negated insult"]
    assert kinds('She said: an idiot did it.') == ["reported insult"]
    assert kinds('The word "idiot" is old.') == ["reported insult"]
    assert kinds("I will kill you") == ["threat"] and kinds("They kill time") == []
    assert kinds("I will never hurt you.") == ["negated threat"]
    assert kinds("idiotic") == [] and kinds("") == []
    plain, aimed = (g.score(np.array([g.features(t)]))[0] for t in ("an idiot", "you idiot"))
    assert aimed > plain > g.score(np.array([g.features("nothing here")]))[0]


def test_contractions_and_inflected_threats():
    g = toxicity.Grammar({"idiot": 5.0}, {}, dict(toxicity.PRIOR), -3.0)
    kinds = lambda t: [k for k, _ in g.clauses(t)]
    assert kinds("You aren't an idiot") == kinds("You aren’t an idiot") == kinds("You are not an idiot") == ["negated insult"]
    assert kinds("Don't kill you") == ["negated threat"] and kinds("I can't hurt you") == ["negated threat"]
    assert kinds("I am killing you") == kinds("he kills you") == kinds("Ich töte dich") == kinds("te mataré, idiot")[:1] == ["threat"]
    assert kinds("Ich bringe dich um") == kinds("Wir bringen euch alle um.") == ["threat"]
    assert kinds("Ich bringe dich nach Hause") == [] and kinds("Ich bringe dich, um drei Uhr") == []
    assert kinds("Ich bringe dich nicht um") == ["negated threat"] and kinds("um dich bringe ich") == []


def test_long_sentences_and_late_targets():
    g = toxicity.Grammar({"idiot": 5.0}, {}, dict(toxicity.PRIOR), -3.0)
    kinds = lambda t: [k for k, _ in g.clauses(t)]
    long = "word " * 2_000
    assert kinds(f"Fine. She said {long} idiot {long}. An idiot") == ["reported insult", "insult"]
    assert kinds(f"You {long} idiot") == ["insult at target"] and kinds(f"You! {long} idiot") == ["insult"]
    assert kinds(f'" {long} idiot " said one') == ["reported insult"]
    assert kinds("Kill you") == ["threat"] and kinds("never hurt you") == ["negated threat"]
    assert kinds("They kill an idiot") == ["insult"] and kinds("kill the idiot, you") == ["insult"]
    assert kinds("kill the idiot in you") == ["threat"]


def test_composed_machine_equals_the_cascade():
    start, machine = toxicity.compose()
    for word in itertools.product("ITNQRES", repeat=5):
        state, a, b, c = start, 0, 0, ("", False, False)
        for symbol in word:
            state, out = machine[state, symbol]
            a, x = toxicity._reported(a, symbol)
            b, x = toxicity._negated(b, x)
            c, x = toxicity._clause(c, x)
            assert x == out


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint_equals_definition_and_spark_hash(spark, sf_dir):
    for t in ("", "A", "a B", "ÀB c d e  f\tg", "x " * 500):
        assert simhash.fingerprint(t.encode()) == _fingerprint(t)
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    got = {r["_id"]: r["fp"] % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert got == {r.doc_id: _fingerprint(r.text) for r in docs.collect()}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_are_all_close_pairs_once(frame, bits):
    rng = np.random.default_rng(bits)
    values = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(values):
        for _ in range(4):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    values |= {0, 1, 2**63, 2**64 - 1}
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in values)
    got = [tuple(sorted(r)) for r in simhash.linked(frame("fp long", [(x,) for x in signed]), bits).collect()]
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= bits}
    assert len(got) == len(set(got)) and set(got) == want


def _reach(nodes, pairs):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(frame):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(frame("a long, b long", [*pairs, (None, 3)])).collect()}
    assert got == {k: v for k, v in _reach({x for p in pairs for x in p}, pairs * 2).items()}
    star = [(0, i) for i in range(1, 3000)]
    assert {r.root for r in components(frame("a long, b long", star)).collect()} == {0}
    assert components(frame("a long, b long", [])).count() == 0


def test_near_duplicates_and_odd_rows(spark, sf_dir, odd, frame):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = _reach(fps, sorted(pairs)) if pairs else {k: k for k in fps}
    assert {k: (f"{fps[k]:016x}", want[k]) for k in fps} == {k: (r.fingerprint, r.component_id) for k, r in got.items()}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    kept = simhash.deduplicate(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(i for i in ids if i) == [1, 4, 5] and len([i for i in ids if i is None]) == 1
    assert simhash.near_duplicates(frame(DOCS, [])).count() == 0 and simhash.deduplicate(frame(DOCS, [])).count() == 0


TOY = pieces.Vocabulary(
    ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "▁a", "ab", "ba", "▁ab", "aba", "."],
    [0.0] * 257 + [-3.0, -1.0, -1.5, -2.5, -1.2, -1.9, -4.0, -3.1, -1.0],
    "u" + "b" * 256 + "n" * 9,
)


def test_one_text_of_each_group_stays(frame):
    a, b = "one two three four five " * 9, "an other text of words altogether " * 9
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, a, "en", "s", 3), (3, b, "x", None, 4), (3, b, "x", None, 4), (None, a, "q", "s", 5)]
    docs = frame(DOCS, rows)
    kept = simhash.deduplicate(docs).collect()
    # The id 1 stands for two texts; each is the smallest of its group.
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b)])
    alone = simhash.deduplicate(docs.filter("doc_id = 3 OR doc_id IS NULL")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in alone) == sorted([(0, a), (3, b)])
    clash = docs.withColumns({c: F.lit(c) for c in ("_kept", "_lone", "_k", "_fp", "fp", "row", "k1", "k2", "root", "n", "_id")})
    assert simhash.deduplicate(clash).columns == clash.columns and simhash.deduplicate(clash).count() == 2


def _segmentations(v, s):
    if not s:
        return [(0.0, ())]
    out = []
    for n in range(1, len(s) + 1):
        if s[:n] in v.ids:
            i, score = v.ids[s[:n]]
            out += [(score + x, (i, *ids)) for x, ids in _segmentations(v, s[n:])]
    if s[0] not in v.ids:
        raw = s[0].encode()
        out += [(v.floor * len(raw) + x, (*(v.bytes[b] for b in raw), *ids)) for x, ids in _segmentations(v, s[1:])]
    return out


@pytest.mark.parametrize("text", ["", "a", "abab", "ab ba.", "a  b", " a ", "aé.b", "ba\nab", "aba.aba"])
@pytest.mark.parametrize("n", [1, 3, 7])
def test_n_best_against_all_segmentations(text, n):
    everything = sorted((s for s, _ in _segmentations(TOY, "▁" + text.replace(" ", "▁") if text else "")), reverse=True)
    best, ranked = TOY.encode(text, n)
    assert [s for s, _ in ranked] == pytest.approx(everything[:n])
    assert TOY.decode(best) == text
    spelled = [tuple(TOY.spell(text, picks)) for _, picks in ranked]
    assert len(set(spelled)) == len(spelled) and all(TOY.decode(list(x)) == text for x in spelled)
    if text:
        backward = TOY.n_best("▁" + text.replace(" ", "▁"), n)
        assert [s for s, _ in backward] == pytest.approx(everything[:n])


def test_unbroken_runs():
    v = pieces.Vocabulary.load()
    run = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"), 200_000))
    best, ranked = v.encode(run, 4)
    scores = [s for s, _ in ranked]
    assert v.decode(best) == run and len(scores) == 4 and scores == sorted(scores, reverse=True)
    assert scores[0] == pytest.approx(sum(v.scores[i] for i in best))
    for score, picks in ranked:
        ids = v.spell(run, picks)
        assert v.decode(ids) == run and score == pytest.approx(sum(v.scores[i] for i in ids))


@pytest.mark.parametrize("n", [1, 4, 20])
def test_n_best_of_longer_runs(n):
    word = "".join(np.random.default_rng(n).choice(list("abé."), 300))
    best = [[0.0]]  # per position the n best scores
    for ends in TOY.edges(word)[1:]:
        best.append(sorted((x + s for i, s, _ in ends for x in best[i]), reverse=True)[:n])
    found = TOY.n_best(word, n)
    assert [s for s, _ in found] == pytest.approx(best[-1]) and len({ids for _, ids in found}) == len(found)


def test_pieces_round_trip(spark, sf_dir, odd, frame):
    rows = Q.REG.queries["op9_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == 1000 and all(r.round_trip and len(r.scores) <= 4 and r.scores == sorted(r.scores, reverse=True) for r in rows)
    coded = pieces.encode(odd, alternatives=True)
    texts = sorted(r.text for r in pieces.decode(coded.select("ids")).collect())
    assert texts == sorted(t or "" for _, t, *_ in ODD)
    assert all(list(r.ids) == list(r.paths[0]) for r in coded.collect())
    assert pieces.encode(frame(DOCS, [])).count() == 0
    assert pieces.decode(frame("ids array<int>", [(None,)])).first().text is None
