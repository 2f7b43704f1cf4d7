"""The paths taken for hot keys, many rows and large sides give the plain answer."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlake.functions import exprs, inverted
from auditlake.functions.ordering import exact_quantiles, next_value, prefix_sums
from auditlake.functions.substrings import occurrences
from auditlake.operators import charts, fingerprint, profile, query, retrieve, search, state, transactions, usage
from auditlake.operators import query as q
from auditlake.sources import sinks
from auditlake.sources.tables import load


def skewed(spark, n=6000):
    """Two thirds of the rows share one key, a tenth has none."""
    key = F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 10 == 0, None).otherwise(
        (F.col("id") % 40).cast("string")
    )
    return spark.range(n).select(
        key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), F.col("id"), (F.col("id") % 7).alias("w")
    )


def test_prefix_sums_equal_a_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "id", F.sum("w").over(w).alias("s"), F.sum("w").over(Window.partitionBy("k")).alias("_total"))
    got = prefix_sums(df, ["k"], [F.col("v"), F.col("id")], {"s": "w"}, total_of="s")
    assert sorted(map(tuple, got.select("k", "id", "s", "_total").collect()), key=str) == sorted(
        map(tuple, want.collect()), key=str
    )


def test_prefix_sums_without_keys(spark):
    df = skewed(spark)
    got = prefix_sums(df, [], [F.col("id")], {"n": F.lit(1).cast("bigint")})
    assert got.filter(F.col("n") != F.col("id") + 1).count() == 0


def test_hot_key_is_spread(spark):
    """No task of the ranked pass holds the whole hot key."""
    df = skewed(spark).filter("k = 'hot'")
    sizes = (
        df.repartitionByRange(8, "k", "v", "id").groupBy(F.spark_partition_id()).count().select("count").collect()
    )
    assert max(s[0] for s in sizes) < df.count() / 2


def test_next_value_equals_lead(spark):
    df = skewed(spark)
    want = df.select("k", "id", F.lead("w").over(Window.partitionBy("k").orderBy("id")).alias("nxt"))
    got = next_value(df, ["k"], [F.col("id")], "w", "nxt").select("k", "id", "nxt")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_row_numbers(spark):
    df = skewed(spark)
    want = df.withColumn("row_num", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).cast("bigint"))
    got = q.row_numbers(df, "k", "v", "id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_exact_quantiles(spark):
    df = skewed(spark)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    values: dict = {}
    for r in df.collect():
        values.setdefault(r["k"], []).append(r["v"])
    assert set(got) == set(values)
    for k, v in values.items():
        for name, p in {"a": 0.25, "b": 0.5, "c": 0.99}.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), abs=1e-6)


@pytest.mark.parametrize("rows", [60_000, 300])
def test_quantiles_of_groups_of_any_size(spark, rows):
    """Groups of one row to 40,000 rows, half of the values infinite or alike."""
    value = (
        F.when(F.col("id") % 4 == 0, 50.0).when(F.col("id") % 7 == 0, float("-inf")).when(F.col("id") % 11 == 0, float("inf"))
        .otherwise(F.round(F.rand(7) * 1000, 2))
    )
    df = spark.range(rows).select(
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 100 == 0, None).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        value.alias("v"),
    ).checkpoint()
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    seen: dict = {}
    for r in df.collect():
        seen.setdefault(r["k"], []).append(r["v"])
    with np.errstate(invalid="ignore"):
        for got, values in [
            *((r, seen[r["k"]]) for r in exact_quantiles(df, ["k"], "v", probs).collect()),
            (exact_quantiles(df, [], "v", probs).first(), sum(seen.values(), [])),
        ]:
            values = sorted(values)
            for name, p in probs.items():
                low, high = values[int(np.floor((len(values) - 1) * p))], values[int(np.ceil((len(values) - 1) * p))]
                if np.isfinite([low, high]).all() or low == high:
                    assert got[name] == pytest.approx(np.quantile(values, p) if low != high else low)


def test_half_infinite_values_on_both_sides_of_the_old_limit(spark):
    for rows in (10_000, 100_000):
        df = spark.range(rows).select(F.when(F.col("id") % 5 < 3, float("-inf")).otherwise(F.col("id").cast("double")).alias("v"))
        assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == float("-inf")


def test_quantiles_of_nothing(spark):
    row = exact_quantiles(skewed(spark).filter("k = 'none'"), [], "v", {"m": 0.5}).first()
    assert row["m"] is None


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 8)))]
    rows[3] = (3, rows[0][1])
    return spark.createDataFrame(rows, "id bigint, embedding array<float>"), np.array([r[1] for r in rows])


def brute(qm, cm, k, metric):
    qm, cm = qm.astype("float32").astype("float64"), cm.astype("float32").astype("float64")
    if metric == "cosine":
        d = 1 - (qm @ cm.T) / np.outer(np.linalg.norm(qm, axis=1), np.linalg.norm(cm, axis=1))
    else:
        d = ((qm[:, None, :] - cm[None, :, :]) ** 2).sum(-1)
    d = np.round(d, 6)
    return {(i, int(c)) for i in range(len(qm)) for c in np.lexsort((np.arange(len(cm)), d[i]))[:k]}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("in_task", [1000, 0])
def test_knn_join(spark, metric, in_task):
    qs, qm = vectors(spark, 60, 1)
    cs, cm = vectors(spark, 500, 2)
    got = retrieve.knn_join(qs, cs, 4, "id", "id", metric=metric, in_task=in_task, qblock=13, cblock=70)
    assert {(r["query_id"], r["item_id"]) for r in got.collect()} == brute(qm, cm, 4, metric)


def test_knn_finds_itself(spark):
    df, m = vectors(spark, 200, 3)
    row = retrieve.knn(df, [float(x) for x in m[17].astype("float32")], 1, key="id").first()
    assert (row["id"], row["distance"]) == (17, 0.0)
    same, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    three = spark.createDataFrame([(1, same), (2, other)], "id bigint, embedding array<double>")
    assert [(r["id"], r["distance"]) for r in retrieve.knn(three, same, 2, key="id").collect()] == [(1, 0.0), (2, 1.0)]


def test_knn_skips_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    assert [r["id"] for r in retrieve.knn(df, [1.0, 0.0], 9, key="id").collect()] == [1]


def recall(near, exact):
    return near.select("query_id", "item_id").intersect(exact.select("query_id", "item_id")).count() / exact.count()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_ann_recall_at_its_defaults(spark, sf):
    """Every twentieth vector against all rows; the vectors of these tables have little structure."""
    df = load(spark, f"/root/testdata/sf{sf}", "embeddings")
    some = df.filter("vec_id % 20 = 0")
    exact = retrieve.knn_join(some, df, 5, "vec_id", "vec_id")
    near = retrieve.ann_join(some, df, 5, "vec_id", "vec_id", 64)
    assert recall(near, exact) >= 0.9
    assert near.filter("query_id = item_id AND place = 1 AND distance = 0").count() == some.count()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_ann_compares_few_pairs_where_vectors_cluster(spark, metric):
    """Compared pairs per query grow with the root of the rows, and one list may hold most rows."""
    rng = np.random.default_rng(9)
    visited = []
    for n in (900, 3600):
        middle = rng.normal(size=(int(n**0.5), 8)) * 4
        of = np.where(rng.random(n) < 0.3, 0, rng.integers(0, len(middle), n))
        points = middle[of] + rng.normal(size=(n, 8)) * 0.1
        rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(-1, [0.0] * 8), (-2, None), (-3, [float("nan")] * 8), (-4, [1.0])]
        df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
        some = df.filter("id % 30 = 0 OR id < 0")
        near = retrieve.ann_join(some, df, 4, "id", "id", 8, metric=metric, qblock=16, cblock=100)
        exact = retrieve.knn_join(some.filter("id >= 0"), df.filter("id >= 0"), 4, "id", "id", metric=metric)
        assert recall(near, exact) >= 0.9
        left, right = (x.select(F.col("id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec")).filter("id >= 0") for x in (some, df))
        centres = inverted.learn(right, int(n**0.5), n, metric)
        probes = retrieve._measured(left.withColumnRenamed("item_id", "query_id"), right, centres, 4, metric, 95)
        visited.append(probes / len(centres))
    assert visited[1] < 0.3 and visited[1] <= visited[0]


def test_lists_are_learnt_on_all_rows(spark):
    """Plain k-means over every row, of which there are many for each list."""
    points = np.random.default_rng(4).normal(size=(900, 8))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "item_id bigint, vec array<double>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = unit[sorted(range(900), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:6]]
    for _ in range(inverted.ROUNDS):
        home = (unit @ want.T).round(9).argmax(axis=1)
        means = np.array([unit[home == b].mean(axis=0) for b in range(6)])
        want = (means / np.linalg.norm(means, axis=1, keepdims=True)).round(6)
    got = inverted.learn(df.repartition(5), 6, 900, "cosine")
    assert np.abs(got - want).max() < 2e-6
    assert np.abs(inverted.learn(df, 6, 900, "cosine", per_list=20) - want).max() > 0.01


def test_ann_join_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, embedding array<float>")
    assert retrieve.ann_join(one, df, 2, "id", "id", 2).count() == 0 and retrieve.ann_join(df, one, 2, "id", "id", 2).count() == 0


def words(seed, n, lo, hi):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(lo, hi))) for _ in range(n)})


@pytest.mark.parametrize("most", [10**6, 60])
def test_occurrences(spark, most):
    """One automaton, and many small ones."""
    needles, hay = words(1, 80, 1, 6), words(2, 60, 3, 30)
    names = spark.createDataFrame([(w, w) for w in needles] + [("none", None), ("empty", "")], "n string, p string")
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(hay)] + [(-1, None), (-2, "")], "h bigint, t string")
    got = occurrences(rows, ["h"], "t", names, "n", "p", most=most).collect()
    want = {(i, a) for a in needles for i, b in enumerate(hay) if a in b}
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want
    assert occurrences(rows, ["h"], "t", names.filter("n = 'none'"), "n", "p").count() == 0


def test_a_name_in_every_text(spark):
    """A common name is found once per text and makes no group of its own."""
    texts = spark.range(20_000).select("id", F.concat(F.lit("the the "), F.col("id").cast("string")).alias("t"))
    names = spark.createDataFrame([("THE",), ("the",), ("199",), ("x",)], "name string")
    out = search.mentions(texts, "id", "t", names, "name", n=2)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("name").count().orderBy("name").collect() == [
        ("199", sum("199" in str(i) for i in range(20_000))), ("THE", 20_000), ("the", sum("199" not in str(i) for i in range(20_000))),
    ]


@pytest.mark.parametrize("most", [10**6, 20])
def test_mentions(spark, most):
    names, texts = words(3, 30, 1, 6), words(4, 40, 2, 40)
    out = search.mentions(
        spark.createDataFrame(list(enumerate(texts)), "id bigint, t string"), "id", "t",
        spark.createDataFrame([(n.upper(),) for n in names], "name string"), "name", most=most,
    )
    want = {
        (i, n.upper(), p + 1)
        for i, t in enumerate(texts)
        for p, n in enumerate([n for n in names if n in t][:3])
    }
    assert want and {tuple(r) for r in out.collect()} == want


def match_one(name, known):
    if name in known:
        return name
    for k in known:
        a, b = name.lower(), k.lower()
        if a == b or (len(a) > 3 and a in b) or (len(b) > 3 and b in a):
            return k
    return None


@pytest.mark.parametrize("most", [10**6, 50])
def test_match_names(spark, most):
    known = [w.upper() if i % 3 else w for i, w in enumerate(words(5, 40, 2, 9))]
    given = words(6, 60, 2, 9) + known[:5]
    got = search.match_names(
        spark.createDataFrame([(g,) for g in given], "g string"), "g",
        spark.createDataFrame(list(enumerate(known)), "o bigint, k string"), "k", "o", most=most,
    )
    want = {(g, match_one(g, known)) for g in given if match_one(g, known)}
    assert {(r["given"], r["known"]) for r in got.collect()} == want


def test_content_fingerprint_ignores_order(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    plain = fingerprint.content_fingerprint(df).first()
    assert fingerprint.content_fingerprint(df.repartition(13).orderBy("c_name")).first() == plain
    changed = df.withColumn("c_acctbal", F.when(F.col("c_custkey") == 3, 0.0).otherwise(F.col("c_acctbal")))
    assert fingerprint.content_fingerprint(changed).first() != plain


def test_table_fingerprint_is_stable(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    one = lambda d, **kw: fingerprint.table_fingerprint("c", d, **kw).first()["fingerprint"]
    plain = one(df)
    assert len(plain) == 16 and one(df.repartition(5)) == plain
    assert one(df.select(*reversed(df.columns))) == plain
    assert one(df.withColumn("c_custkey", F.col("c_custkey").cast("string"))) != plain
    assert one(df, links=["c_nationkey->nation.n_nationkey"]) != plain


def test_distinct_samples_over_many_batches(spark):
    df = spark.range(20_000).select((F.col("id") % 977).alias("a"), F.lit(None).cast("string").alias("b"))
    got = {r["column_name"]: r["sample_values"] for r in profile.distinct_samples(df.repartition(7)).collect()}
    assert got == {"a": sorted(map(str, range(977)))[:5]}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_samples_keep_the_sign_of_a_zero(spark, frame, kind):
    """-0.0 and 0.0 are one value and two texts."""
    rows = [(-0.0, -0.0, 0.0, 1), (0.0, -0.0, 0.0, 1), (-1.5, 2.0, None, 1), (-0.0, None, None, 1)]
    df = frame(f"a {kind}, b {kind}, c {kind}, d bigint", rows)
    got = {r["column_name"]: (r["distinct_count"], r["sample_values"]) for r in profile.column_profile(df.repartition(3)).collect()}
    assert got == {"a": (2, ["-0.0", "-1.5", "0.0"]), "b": (2, ["-0.0", "2.0"]), "c": (1, ["0.0"]), "d": (1, ["1"])}


def test_approx_profile_is_close(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    exact = {r["column_name"]: r["distinct_count"] for r in profile.column_counts(df).collect()}
    rows = {r["column_name"]: r for r in state.approx_profile(df).collect()}
    assert len(rows) == 11
    for c, r in rows.items():
        assert r["approx_distinct"] == pytest.approx(exact[c], rel=0.05)
    median = profile.numeric_summary(df, ["l_extendedprice"]).first()["median"]
    assert rows["l_extendedprice"]["approx_median"] == pytest.approx(median, rel=0.02)
    for c in ("l_returnflag", "l_linestatus"):
        top = {(r["value"], r["n"]) for r in profile.categorical_summary(df, 5, [c]).collect()}
        assert {(v["value"], v["n"]) for v in rows[c]["common_values"]} == top


def test_approx_profile_of_any_kind(spark):
    df = spark.sql("""
        SELECT id, if(id % 3 = 0, NULL, cast(id AS decimal(30, 2)) + 123456789012345678901234.5) AS d, id % 2 = 0 AS b, array(id, 1) AS a,
               repeat('x', int(id)) AS t, date_add(date'2020-01-01', int(id)) AS day, cast(NULL AS string) AS empty, (1L << 60) + id AS big
        FROM range(200)""")
    rows = {r["column_name"]: r for r in state.approx_profile(df).collect()}
    assert rows["big"]["max_value"] == str((1 << 60) + 199) and rows["d"]["min_value"] == "123456789012345678901235.50"
    assert rows["d"]["null_count"] == 67 and rows["day"]["approx_median_time"].startswith("2020-04-0")
    assert rows["t"]["approx_median"] == pytest.approx(100, abs=2) and rows["a"]["approx_distinct"] == 200
    assert rows["empty"]["non_null_count"] == 0 and rows["empty"]["common_values"] is None and rows["empty"]["approx_distinct"] == 0
    assert {(v["value"], v["n"]) for v in rows["b"]["common_values"]} == {("true", 100), ("false", 100)}
    assert state.approx_profile(df.filter("false")).filter("total_count = 0 AND approx_median IS NULL").count() == 8


def test_only_changed_files_are_profiled_again(spark, tmp_path):
    path = str(tmp_path / "t a+b")
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.concat(F.lit("n"), F.col("id") % 7).alias("s"))
    sinks.replace_partition(rows, path, "g")
    first = state.refresh(spark, path)
    known = spark.createDataFrame(first.collect(), first.schema)
    again = state.refresh(spark, path, known)
    assert "ObjectHashAggregate" not in again._jdf.queryExecution().executedPlan().toString()
    sinks.replace_partition(rows.filter("g = 1").withColumn("v", F.col("v") + 10_000), path, "g")
    after = state.refresh(spark, path, known)
    fresh = {r["_file"] for r in after.select("_file").collect()} - {r["_file"] for r in known.select("_file").collect()}
    assert fresh and all("/g=1/" in f for f in fresh)
    table = spark.read.parquet(path)
    exact = ["column_name", "total_count", "non_null_count", "min_value", "max_value", "avg_value"]
    a = state.reprofile(spark, path, after).select(*exact, "approx_distinct").orderBy("column_name").collect()
    b = state.approx_profile(table).select(*exact, "approx_distinct").orderBy("column_name").collect()
    assert a == b


def test_sums_by_type(spark):
    big = spark.createDataFrame([((1 << 60) + 1, "a"), ((1 << 60) + 2, "a"), (-3, "b")], "v bigint, k string")
    assert query.scalar_agg(big, "sum", "v").first()["value"] == (1 << 61)
    assert query.scalar_agg(big, "max", "v").first()["value"] == (1 << 60) + 2
    row = profile.numeric_range(big, ["v"]).first()
    assert (row["min_exact"], row["max_exact"]) == ("-3", str((1 << 60) + 2))
    money = spark.sql("SELECT 'a' AS k, cast(v AS decimal(30, 2)) AS v FROM VALUES ('12345678901234567890.12'), ('0.01') AS t(v)")
    assert str(charts.shares(money, "k", "v").first()["total"]) == "12345678901234567890.13"
    joined = query.join_agg(money, spark.sql("SELECT 'a' AS k, 'g' AS g"), "k", "k", "g", "v").first()
    assert str(joined["total"]) == "12345678901234567890.13"


def test_double_sums_do_not_depend_on_order(spark):
    rnd = random.Random(4)
    values = [rnd.uniform(-1e9, 1e9) for _ in range(3000)] + [round(rnd.uniform(-1e5, 1e5), 2) for _ in range(3000)] + [1e-13, -0.00000001, 3e14 + 0.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    sums = {df.repartition(n).orderBy(F.xxhash64("v", F.lit(n))).agg(exprs.total_of("v").alias("t")).first()["t"] for n in (1, 3, 7)}
    assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(values), rel=1e-15)
    odd = spark.createDataFrame([(float("inf"),), (1.0,), (None,)], "v double")
    assert odd.agg(exprs.total_of("v")).first()[0] == float("inf") and odd.filter("v IS NULL").agg(exprs.total_of("v")).first()[0] is None


def test_snapshots_with_null_and_repeated_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "x"), (None, None), (2, "c"), (3, "d")]
    old = spark.createDataFrame(rows, "k bigint, h string")
    same = fingerprint.snapshot_changes(old, old, "k", "h").collect()
    assert len(same) == len(rows) and {r["status"] for r in same} == {"unchanged"}
    new = spark.createDataFrame([(1, "a"), (1, "z"), (None, "x"), (2, "q"), (4, "e")], "k bigint, h string")
    got = sorted((str(r["k"]), r["status"]) for r in fingerprint.snapshot_changes(old, new, "k", "h").collect())
    assert got == sorted([
        ("1", "unchanged"), ("1", "changed"), ("1", "removed"), ("None", "unchanged"), ("None", "removed"), ("2", "changed"), ("3", "removed"), ("4", "added"),
    ])


def test_a_changed_link_is_relational_and_weighs_high(spark, sf_dir):
    tables = {t: load(spark, sf_dir, t) for t in ("nation", "region")}
    tree = lambda **kw: fingerprint.fingerprint_tree(tables, {"nation": ["n_nationkey"]}, kw.get("links", {"nation": ["n_regionkey->region.r_regionkey"]}))
    plain = tree()
    assert fingerprint.tree_diff(plain, tree()).count() == 0
    row = fingerprint.tree_diff(plain, tree(links={})).collect()
    assert [(r["table_name"], r["impact"], r["relational_changed"], r["structural_changed"], r["changed_parts"]) for r in row] == [
        ("nation", "high", True, False, ["relational.link"])
    ]
    top = lambda t: t.filter("level = 'schema'").first()["fingerprint"]
    assert top(plain) != top(tree(links={}))


def test_one_file_per_small_group(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 5).alias("g"), "id").repartition(16)
    path = sinks.replace_partition(df, str(tmp_path / "t"), "g")
    assert len(spark.read.parquet(path).inputFiles()) <= 8 and spark.read.parquet(path).count() == 4000


def test_actors_of_an_empty_log(spark):
    log = spark.createDataFrame([], "a string, ts timestamp_ntz, ok boolean, d double")
    assert usage.actor_performance(log, "a", "ts", F.col("ok"), "d").count() == 0


def test_funnel_with_a_hot_entity(spark):
    rows = [(1, i, s) for i, s in enumerate("abcabc" * 200)] + [(2, 1, "b"), (2, 2, "a"), (3, 1, "a"), (3, 2, "c"), (3, 3, "b")]
    df = spark.createDataFrame(rows, "e bigint, t bigint, s string").withColumn("ts", F.timestamp_seconds("t"))
    out = charts.funnel(df, "e", "ts", "s", ["a", "b", "c"]).orderBy("step").collect()
    assert [(r["state"], r["entities"]) for r in out] == [("a", 3), ("b", 2), ("c", 1)]


def test_funnel_against_a_walk(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([0, 0, 0, *range(1, 60)]), rnd.randint(0, 400), rnd.choice("abcdx")) for _ in range(6000)] + [(None, 1, "a"), (5, None, "a")]
    df = spark.createDataFrame(rows, "e bigint, t bigint, s string").withColumn("ts", F.timestamp_seconds("t"))
    for steps in (["a", "b", "c", "d"], ["a", "b", "a"], ["d"]):
        done = {}
        for e in {r[0] for r in rows if r[0] is not None}:
            k = 0
            for t in sorted({r[1] for r in rows if r[0] == e and r[1] is not None}):
                if k < len(steps) and any(r == (e, t, steps[k]) for r in rows):
                    k += 1
            done[e] = k
        out = charts.funnel(df, "e", "ts", "s", steps)
        assert [r["entities"] for r in out.orderBy("step").collect()] == [sum(k > i for k in done.values()) for i in range(len(steps))]
        assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()


def test_velocity_of_one_busy_slot(spark):
    """Nine tenths of the rows are one user's within one hour."""
    rnd = random.Random(3)
    rows = [(1, rnd.randint(0, 3_500_000)) for _ in range(9000)] + [(u, rnd.randint(0, 40_000_000)) for u in range(2, 12) for _ in range(100)]
    df = spark.createDataFrame(rows, "u bigint, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["u"]: (r["peak_count"], r["instants_over"]) for r in transactions.velocity_all(df, "u", "ts", min_n=5).collect()}
    want = {}
    for u in {r[0] for r in rows}:
        times = np.sort(np.array([ms for x, ms in rows if x == u]))
        inside = np.searchsorted(times, np.unique(times), "right") - np.searchsorted(times, np.unique(times) - 3_600_000, "left")
        if (inside > 5).any():
            want[u] = (int(inside.max()), int((inside > 5).sum()))
    assert got == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0, 5, 10, 10]] + [(None,)], "v double")
    assert [r["n"] for r in charts.histogram(df, "v", 4).orderBy("bin").collect()] == [2, 0, 1, 2]
    flat = charts.histogram(df.filter("v = 5"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [1, 0, 0, 0]
