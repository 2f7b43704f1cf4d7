"""WARC, sharding, PII, mixing, vector links and the pipeline on small frames and against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import mixing, pii, pstable, sharding, warc
from auditlake.llm import queries as Q
from auditlake.llm.common import work_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def _archive(spark, pages, **options):
    return warc.write_warc(warc.page_records(pages), work_dir(spark, "warc"), **options)


def test_archives_give_back_what_was_written(spark, frame):
    long = "é" * 700
    pages = frame(PAGES, [
        (1, "http://a/1\r\nX: y", long), (9, None, long), (5, "http://a/5", long), (2, "http://b/", None), (3, "http://b/2", ""),
        (4, "u", "short"), (6, "u", "short"), (None, "n", long), (7, "w", "WARC/1.1\r\n\r\nWARC-Type: response\r\n" * 50), (8, "t", "x" * 5_000_000),
    ]).withColumns({"record_type": F.lit("z"), "payload": F.lit(1)})
    for compression in ("gzip", "none"):
        path = _archive(spark, pages, compression=compression, file_bytes=4000)
        rows = {r.record_id: r for r in warc.read_warc(spark, path, split_bytes=3000).collect()}
        got = {k: (r.record_type, r.refers_to, r.payload_length) for k, r in rows.items()}
        assert got["<urn:page:9>"] == ("response", None, 1400)
        for k in ("1", "5", ""):
            assert got[f"<urn:page:{k}>"] == ("revisit", "<urn:page:9>", 1400)
        assert all(got[f"<urn:page:{k}>"][0] == "response" for k in (2, 3, 4, 6, 7, 8))
        assert rows["<urn:page:8>"].payload == b"x" * 5_000_000 and rows["<urn:page:2>"].payload == b""
        assert rows["<urn:page:1>"].payload is None and rows["<urn:page:1>"].target_uri == "http://a/1 X: y"
        assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in rows.values() if r.payload is not None)
        assert rows["<urn:page:1>"].payload_digest == hashlib.sha1(long.encode()).hexdigest()
    assert warc.read_warc(spark, _archive(spark, frame(PAGES, []))).count() == 0


def test_headers_decide_before_payloads(spark, frame):
    pages = frame(PAGES, [(i, f"http://h{i % 2}/{i}", "p" * (1000 + i // 2)) for i in range(20)])
    path = _archive(spark, pages)
    found = warc.read_warc(spark, path).filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1/"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter ", plan) and found.count() == 10
    bare = warc.read_warc(spark, path, payloads="").filter("refers_to IS NOT NULL OR payload IS NULL").collect()
    assert len(bare) == 20 and all(r.payload is None for r in bare)
    one = next(p for p in warc.WarcReader({"path": path}).partitions()).paths[0]
    assert warc.read_warc(spark, one).count() > 0
    with pytest.raises(Exception, match="nowhere|not"):
        warc.read_warc(spark, path + "/nowhere").count()


def test_repeated_page_ids(spark, frame):
    rows = warc.page_records(frame(PAGES, [(1, "u", "q" * 1000)] * 2 + [(None, "u", "r" * 1000)] * 2)).collect()
    assert [r.record_type for r in rows] == ["response"] * 4


def test_shards(spark, frame):
    rows = [(i if i % 7 else None, "same" if i % 3 else None, "en", None, i) for i in range(999)] + [(1000, "é" * 9000, "x", "y", 1)] * 3
    docs = frame(DOCS, rows).withColumns({"shard": F.lit(1), "slot": F.lit("s"), "record": F.lit(2), "bucket": F.lit(0), "h": F.lit(0)})
    out = sharding.write_shards(docs, work_dir(spark, "t"), 7, bucket_bytes=9000).collect()
    counts = np.bincount([r.shard for r in out], minlength=7)
    assert counts.sum() == 1002 and counts.max() - counts.min() <= 1
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(key, (r.record for r in out))) == sorted(map(key, docs.collect()))
    again = sharding.write_shards(docs, work_dir(spark, "t"), 7, bucket_bytes=9000).collect()
    place = lambda rows: sorted((r.shard, r.slot, key(r.record)) for r in rows)
    assert place(out) == place(again)
    order = [r.record.n_chars for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15
    few = sharding.write_shards(frame(DOCS, rows[:3]), work_dir(spark, "t"), 7).collect()
    assert len(few) == 3 and sharding.write_shards(frame(DOCS, []), work_dir(spark, "t"), 7).count() == 0


def test_copies_of_a_row_spread_over_buckets(spark):
    """20,000 equal rows of 5 kB, far more than a bucket holds, and as many others."""
    rows = spark.range(22_000).select(
        F.when(F.col("id") < 20_000, 0).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 20_000, F.lit("x" * 5000)).otherwise(F.concat(F.lit("y"), "id")).alias("text"),
    )
    out = sharding.write_shards(rows, work_dir(spark, "t"), 7, bucket_bytes=1 << 20)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.count_if(F.col("record.doc_id") == 0).alias("copies"))
    found = per.collect()
    assert sum(r.n for r in found) == 22_000 and max(r.n for r in found) - min(r.n for r in found) <= 1
    assert all(r.slots == r.n == r.last + 1 for r in found) and sum(r.copies for r in found) == 20_000
    assert max(r.copies for r in found) < 1.05 * min(r.copies for r in found)
    assert out.select("record.doc_id").distinct().count() == 2001


def test_shards_plan_has_no_python(spark, sf_dir):
    for key in ("op3_sharding", "op4_pii"):
        plan = Q.REG.queries[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_shard_digests(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.REG.queries["op3_sharding"](spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _real(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def _base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.ASCII) if _real(k, m.group()))


TRICKY = [
    "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.2.3 1.2.3", "4539 1488 0343 6467, 4539-1488-0343-6467 1", "45391488034364670000000",
    "12 4539148803436467 7", "+1 (446) 555-8962 osas +1-2 +12345678901234567 +1.2.3.4.5.6.7.8", "日本𝒳 me@x.org\nñ 10.0.0.1é", "@@a@b..c@d.e", "",
    "9" * 3000, "a." * 3000 + "@", ("x@y.zz " + "1.1.1.1 ") * 300, "@" + "a." * 20_000, "+" * 50 + "1" * 9, "4 5 3 9 1 4 8 8 0 3 4 3 6 4 6 7",
]


def test_base_spans_equal_the_patterns(frame):
    rng = np.random.default_rng(2)
    noise = ["".join(rng.choice(list("0123456789 .-+()@ab\n"), 200)) for _ in range(150)]
    texts = [*TRICKY, *noise, None]
    docs = frame(DOCS, [(i, t, None, None, 0) for i, t in enumerate(texts)]).withColumns({"_base": F.lit(1), "_id": F.lit(2), "m_b_ip": F.lit(3)})
    rows = pii.find(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_spans == _base(texts[r.doc_id])
        assert set(filter(None, r.base_spans.split(","))) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [r.base_spans.count(k + ":") for k in PATTERNS]
    assert pii.find(frame(DOCS, [])).count() == 0


def test_trees_add_spans_like_the_real_ones(frame):
    rng = np.random.default_rng(4)
    number = lambda: "".join(map(str, rng.integers(0, 10, 4)))
    rows = [(i, f"call +1 (212) 555-{number()} now, item {number()}-{number()}-{number()}", None, None, 0) for i in range(400)]
    rows.append((1000, "call +1 (212) 555-1234 12345678 now", None, None, 0))  # too many digits for the strict pattern
    got = {r.doc_id: r for r in pii.find(frame(DOCS, rows)).collect()}
    assert all(got[i].spans == got[i].base_spans and got[i].n_phone == 1 for i in range(400))
    assert got[1000].n_phone == 0 and "phone:" in got[1000].spans


def test_disguised_emails_go_with_plain_ones(frame):
    plain = [(i, f"write to bob{i}@site{i}.com today", None, None, 0) for i in range(400)]
    forms = ["bob{0} (at) site{0} (dot) com", "bob{0}[at]site{0}[dot]com", "bob{0} at site{0} dot com"]
    veiled = [(1000 + i, f"write to {forms[i % 3].format(i)} today", None, None, 0) for i in range(400)]
    other = [(2000 + i, f"we met at noon, item {i}-{i}-{i}-{i}, dot to dot", None, None, 0) for i in range(200)]
    got = {r.doc_id: r for r in pii.find(frame(DOCS, [*plain, *veiled, *other])).collect()}
    assert all(got[i].spans == got[i].base_spans and got[i].n_email == 1 for i in range(400))
    assert all(got[1000 + i].n_email == 0 and got[1000 + i].spans == f"email:9:{9 + len(forms[i % 3].format(i))}" for i in range(400))
    assert all("email" not in got[2000 + i].spans for i in range(200))


def test_redaction(frame):
    rows = [(1, "me@x.org and 10.0.0.1, +1 (446) 555-8962é", "en", None, 3), (2, None, "en", "s", 0), (None, "none here", None, None, 1), (3, "", None, None, 0)]
    docs = frame(DOCS, rows * 2)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["[EMAIL] and [IP], [PHONE]é", "None", "none here", ""] * 2)


def test_word_counts():
    texts = [None, "", " a", "a", "b c d ", "\n\t", "é日 x"]
    assert list(mixing.word_counts(pa.array(texts, pa.string()))) == [0, 0, 1, 1, 2, 0, 2]
    assert list(mixing.word_counts(pa.array(texts, pa.string()).slice(2, 3))) == [1, 1, 2]
    assert list(mixing.word_counts(pa.array([], pa.string()))) == []


def test_water_fill_and_tree():
    targets = mixing.water_fill([10, 10, 100, 0], [5, 2, 1, 5], 180)
    assert sum(targets) == pytest.approx(180) and targets[0] == 20 and targets[1] == 20 and targets[3] == 0
    quotas = np.array([13, 0, 200, 7])
    split = mixing.splitting_tree(quotas, 6, np.random.default_rng(1))
    assert (split.sum(0) == quotas).all() and np.ptp(split.sum(1)) <= 1 and (split >= 0).all()


def _mix_rows(n):
    rng = np.random.default_rng(8)
    return [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 11 else None, "en", ["b", "a", None, "é"][i % 4] if i % 3 else "a", 0) for i in range(n)]


def test_mix_meets_targets(spark, frame):
    rows = _mix_rows(3000)
    docs = frame(DOCS, rows).withColumns({"_row": F.lit(1), "size": F.lit(2), "shard": F.lit(3), "copy": F.lit("k")})
    out = mixing.taken(mixing.plan(docs)).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total, of = {}, {i: s for i, _, _, s, _ in rows}
    for i, s in of.items():
        total[s] = total.get(s, 0) + size[i]
    names = sorted(total, key=lambda s: (s is None, s))
    want = dict(zip(names, mixing.water_fill([total[s] for s in names], [5, 2, 1, 5], 1.5 * sum(total.values())), strict=True))
    got = {}
    for r in out:
        s = of[r["_id"]]
        assert r.size == size[r["_id"]] and r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        got[s] = got.get(s, 0) + r.taken
    assert len(out) == 3000 and all(abs(got[s] - want[s]) <= 60 for s in names)
    assert sorted(map(str, out)) == sorted(map(str, mixing.taken(mixing.plan(docs)).collect()))
    clash = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in ("_source", "_block", "_turn", "_copy", "_shard", "row", "_id", "_text", "_from")})
    mixed = mixing.mixed(clash)
    rows = mixed.collect()
    assert mixed.columns == [*clash.columns, "_shard_"] and all(r["_source"] == f"_source{r.doc_id}" and r["_shard"] == f"_shard{r.doc_id}" for r in rows)
    mixed = mixing.mixed(docs)
    rows = mixed.collect()
    assert mixed.columns == [*docs.columns, "_shard"]
    copies = {}
    for r in rows:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert all(copies.get(r["_id"], 0) * r.size == r.taken for r in out) and len({r["_shard"] for r in rows}) == mixing.SHARDS


def test_mix_of_odd_tables(frame):
    assert mixing.taken(mixing.plan(frame(DOCS, []))).count() == 0 and mixing.mixed(frame(DOCS, [])).count() == 0
    odd = frame(DOCS, [(None, None, None, None, None), (1, "", None, "a", 0), (1, "", None, "a", 0)])
    assert [r.taken for r in mixing.taken(mixing.plan(odd)).collect()] == [0, 0, 0]


VECTORS = "vec_id long, embedding array<float>, label int"


def _brute(rows, limit=0.93):
    good = {}
    for i, v, lab in rows:
        if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v):
            good[i] = (np.array(v, np.float32).astype(float), lab)
    links = {i: set() for i, *_ in rows if i is not None}
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                links[a].add(b)
    root = {i: i for i in links}
    for _ in links:
        for a in links:
            root[a] = min([root[a], *(root[b] for b in links[a])])
    return {i: (len(links[i]), root[i]) for i in links}


@pytest.mark.parametrize("block", [7, 1024])
def test_vector_links_against_brute_force(frame, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        spread = rng.uniform(0.02, 0.3)
        rows += [(len(rows) + k, [float(x) for x in centre + rng.normal(size=16) * spread], g % 3) for k in range(12)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [], 1), (505, [1.0, None], 1)]
    rows += [(506, [float(3 * x) for x in rows[0][1]], 0), (507, rows[0][1], 0), rows[0], (508, [1.0, 2.0], 1), (509, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    df = frame(VECTORS, rows).withColumns({"_id": F.lit(1), "v": F.lit(2), "keys": F.lit(3), "n": F.lit(4)})
    out = pstable.near_duplicates(df, block=block).collect()
    want = _brute(rows)
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None}
    assert got == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)


def test_copies_of_a_vector_are_compared_once(frame):
    """3,000 copies of one vector, more than blocks hold, and an id with two vectors."""
    rng = np.random.default_rng(6)
    base = [float(x) for x in rng.normal(size=8)]
    near = [[x + 0.02 for x in base], [x - 0.02 for x in base]]
    rows = [(i, base, 1) for i in range(3000)] + [(5000, near[0], 1), (5001, near[1], 1), (5002, base, 2), (6000, base, 1), (6000, [-x for x in base], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pstable.near_duplicates(frame(VECTORS, rows), block=64).collect()}
    assert got[0] == (3002, 0, True) and got[2999] == (3002, 0, False)
    assert got[5000] == (3002, 0, False) == got[5001] and got[5002] == (0, 5002, True) and got[6000] == (3002, 0, False)


def test_tables_follow_the_rows():
    for rows in (1, 10**3, 10**5, 10**8):
        tables, projections = pstable.planned(rows, 0.93)
        assert pstable.collision_chance(0.93, tables, projections) >= 0.999
        assert rows * pstable.collision_chance(0.0, 1, 1) ** projections <= pstable.CROWD


def test_vector_recall_and_empty(frame):
    assert pstable.collision_chance(0.93) > 0.999 and pstable.collision_chance(0.98) > 0.999999
    assert pstable.collision_chance(0.0) < 0.1
    assert pstable.near_duplicates(frame(VECTORS, [])).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()} and all(len(r.ids) == r.n_pieces for r in out)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, sf_dir).collect()}
    good = [r for r in labels.collect()]
    assert sum((r.doc_id in kept) == bool(r.quality) for r in good) / len(good) > 0.95
    once = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert once.columns == docs.columns and once.count() == once.select("doc_id").distinct().count()
    clean = corpus_pipeline.redact_personal_data(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.filter("n_chars <> length(text)").count() == 0
    assert not [r for r in clean.collect() if _base(r.text)]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().filter("count > 2").count() == 0


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out
