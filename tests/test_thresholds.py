"""Hand-made frames on both sides of every threshold."""

from __future__ import annotations

import datetime as dt

import pytest

from pyspark.sql import functions as F

from auditlake.functions.exprs import micros
from auditlake.operators import findings, fingerprint, profile
from auditlake.operators import findings as f
from auditlake.operators import integrity, quality, relate, statistical, temporal, transactions, usage
from auditlake.operators import query as q

T0 = dt.datetime(2024, 3, 1, 12)


def amounts(frame, values):
    return frame("id bigint, amount double", [(i, float(v)) for i, v in enumerate(values)])


@pytest.mark.parametrize(
    "round_rows,total,risk", [(20, 100, "none"), (21, 100, "medium"), (39, 100, "medium"), (40, 100, "high")]
)
def test_round_ratio(frame, round_rows, total, risk):
    df = amounts(frame, [100.0] * round_rows + [101.5] * (total - round_rows))
    row = transactions.round_ratio(df, "amount").first()
    assert (row["round_small"], row["total"], row["risk_level"]) == (round_rows, total, risk)


def test_round_ratio_of_nothing(frame):
    row = transactions.round_ratio(frame("amount double", [(None,)]), "amount").first()
    assert (row["total"], row["round_percent"], row["risk_level"]) == (0, 0.0, "none")


@pytest.mark.parametrize("n,hits", [(10, 0), (11, 1)])
def test_round_amounts_frequency(frame, n, hits):
    assert transactions.round_amounts(amounts(frame, [500.0] * n + [77.0] * 20), "amount").count() == hits


@pytest.mark.parametrize("n,hits", [(10, 0), (11, 1)])
def test_velocity_last_hour(frame, n, hits):
    rows = [(7, T0 - dt.timedelta(minutes=i)) for i in range(n)]
    rows += [(8, T0 - dt.timedelta(hours=5, minutes=i)) for i in range(30)]
    df = frame("user bigint, ts timestamp_ntz", rows)
    assert [r["user"] for r in transactions.velocity(df, "user", "ts").collect()] == [7] * hits


def test_velocity_needs_less_than_the_window(frame):
    rows = [(7, T0 - dt.timedelta(minutes=6 * i)) for i in range(11)]
    assert transactions.velocity(frame("user bigint, ts timestamp_ntz", rows), "user", "ts").count() == 0


def test_velocity_all_finds_an_old_burst(frame):
    rows = [(8, T0 - dt.timedelta(hours=5, minutes=4 * i)) for i in range(13)]
    rows += [(7, T0 - dt.timedelta(hours=i)) for i in range(30)]
    df = frame("user bigint, ts timestamp_ntz", rows)
    out = [tuple(r) for r in transactions.velocity_all(df, "user", "ts").collect()]
    assert out == [(8, 13, 3)]


@pytest.mark.parametrize("n,hits", [(2, 0), (3, 1)])
def test_structuring(frame, n, hits):
    rows = [(1, T0, 9500.0)] * n + [(1, T0, 8999.0), (1, T0, 9999.5), (2, T0, 4950.0), (2, T0 + dt.timedelta(1), 4950.0)]
    df = frame("user bigint, ts timestamp_ntz, amount double", rows)
    assert transactions.structuring(df, "user", "ts", "amount").count() == hits


def test_off_hours(frame):
    rows = [(h, dt.datetime(2024, 1, 1, h, 30)) for h in range(24)]
    got = {r["id"] for r in transactions.off_hours(frame("id bigint, ts timestamp_ntz", rows), "ts", "id").collect()}
    assert got == {0, 1, 2, 3, 4, 5, 22, 23}


@pytest.mark.parametrize("n,hits", [(10, 0), (11, 1)])
def test_backdated_summary(frame, n, hits):
    rows = [(T0,)] + [(T0 - dt.timedelta(days=30),)] * n + [(T0 - dt.timedelta(days=7),), (T0 - dt.timedelta(days=365),)]
    out = temporal.backdated_summary(frame("ts timestamp_ntz", rows), "ts").collect()
    assert [(r["backdated_count"], r["avg_days_back"]) for r in out] == [(n, 30.0)] * hits


def test_backdated_rows(frame):
    day = dt.timedelta(days=1)
    rows = [(1, T0 - 20 * day, T0), (2, T0 - 20 * day, T0 - 2 * day), (3, T0 - 6 * day, T0), (4, T0 - 9 * day, T0 - day)]
    df = frame("id bigint, created timestamp_ntz, inserted timestamp_ntz", rows)
    out = temporal.backdated_rows(df, "created", "inserted", "id").collect()
    assert [(r["id"], r["days_backdated"]) for r in out] == [(1, 20.0), (4, 9.0)]


@pytest.mark.parametrize("n,hits", [(5, 0), (6, 1)])
def test_future_summary(frame, n, hits):
    df = frame("ts timestamp_ntz", [(T0,)] + [(T0 + dt.timedelta(days=2),)] * n)
    out = temporal.future_summary(df, "ts", T0).collect()
    assert [(r["future_count"], r["avg_days_ahead"]) for r in out] == [(n, 2.0)] * hits


def test_tamper_summary_is_empty_when_in_order(frame):
    df = frame("a timestamp_ntz, b timestamp_ntz", [(T0, T0), (T0, T0 + dt.timedelta(hours=1)), (T0, None)])
    assert temporal.tamper_summary(df, "a", "b").count() == 0
    late = df.union(frame("a timestamp_ntz, b timestamp_ntz", [(T0, T0 - dt.timedelta(hours=3))]))
    assert tuple(temporal.tamper_summary(late, "a", "b").first()) == (1, 3.0)


def digit_frame(frame, counts):
    return amounts(frame, [d * 10 for d, n in counts.items() for _ in range(n)])


def chi(counts):
    total = sum(counts.values())
    e = {d: statistical.BENFORD_PERCENT[str(d)] * total / 100 for d in counts}
    return sum((n - e[d]) ** 2 / e[d] for d, n in counts.items())


LAW = {1: 301, 2: 176, 3: 125, 4: 97, 5: 79, 6: 67, 7: 58, 8: 51, 9: 46}


def test_benford_verdicts(frame):
    assert statistical.benford_test(digit_frame(frame, LAW), "amount").count() == 0
    medium = {**LAW, 1: LAW[1] - 42, 9: LAW[9] + 24}
    assert 15.51 < chi(medium) < 25
    row = statistical.benford_test(digit_frame(frame, medium), "amount").first()
    assert row["risk_level"] == "medium" and row["p_value"] == (0.01 if chi(medium) > 20 else 0.05)
    assert row["chi_square"] == pytest.approx(chi(medium), abs=1e-5)
    high = {**LAW, 9: 200}
    row = statistical.benford_test(digit_frame(frame, high), "amount").first()
    assert (row["risk_level"], row["p_value"]) == ("high", 0.001)


def test_benford_needs_seven_digits(frame):
    assert statistical.benford_test(digit_frame(frame, {d: 500 for d in range(1, 7)}), "amount").count() == 0
    assert statistical.benford_test(digit_frame(frame, {d: 500 for d in range(1, 8)}), "amount").count() == 1



@pytest.mark.parametrize(
    "outliers,total,risk", [(5, 300, "none"), (6, 599, "medium"), (6, 600, "none"), (30, 1200, "medium")]
)
def test_zscore_limits(frame, outliers, total, risk):
    values = [float(i % 2) for i in range(total - outliers)] + [1000.0] * outliers
    row = statistical.zscore_summary(amounts(frame, values), ["amount"], flagged_only=False).first()
    assert (row["outlier_count"], row["risk_level"]) == (outliers, risk)
    shown = statistical.zscore_summary(amounts(frame, values), ["amount"]).count()
    assert shown == (risk != "none")


def test_zscore_of_a_constant(frame):
    row = statistical.zscore_summary(amounts(frame, [4.0] * 20), ["amount"], flagged_only=False).first()
    assert (row["outlier_count"], row["max_z_score"]) == (0, None)


@pytest.mark.parametrize("n,risk", [(0, "none"), (1, "medium"), (99, "medium"), (100, "high")])
def test_orphans(frame, n, risk):
    child = frame("id bigint, p bigint", [(i, 1000 + i % 7) for i in range(n)] + [(-1, 1), (-2, None)])
    parent = frame("k bigint", [(1,), (2,)])
    row = integrity.orphan_counts("child", child, [("p", "parent", parent, "k")]).first()
    assert (row["orphan_count"], row["risk_level"]) == (n, risk)


def test_audit_gaps_and_nulls(frame):
    df = frame("a string, b string", [("x", "y"), (None, "y"), ("x", None), (None, None)])
    assert tuple(integrity.audit_gaps(df, ["a", "b"]).first()) == (3, 4, 75.0)
    assert {tuple(r) for r in integrity.critical_nulls(df, ["a", "b"]).collect()} == {("a", 2), ("b", 2)}
    clean = df.filter("a IS NOT NULL")
    assert [r["column_name"] for r in integrity.permissive_nulls(clean, ["a", "b"]).collect()] == ["b"]


def test_cycles(frame):
    # A self-loop, a pair, a ring of ten, a ring of eleven (too deep), a tail and a dead end.
    edges = [(1, 1), (2, 3), (3, 2)]
    edges += [(100 + i, 100 + (i + 1) % 10) for i in range(10)]
    edges += [(200 + i, 200 + (i + 1) % 11) for i in range(11)]
    edges += [(50, 2), (51, 50), (60, None), (61, 999)]
    out = integrity.cycles(frame("id bigint, ref bigint", edges), "id", "ref").collect()
    assert {(r["start"], r["length"]) for r in out} == {(1, 1), (2, 2), (100, 10)}
    assert next(r["path"] for r in out if r["start"] == 2) == [2, 3]


def test_unverified_fks(frame):
    rows = [("t", f"c{i}", None) for i in range(2)] + [("t", "ok", 1.0)] + [("u", f"c{i}", 0.5) for i in range(3)]
    links = frame("source_table string, source_column string, inclusion_ratio double", rows)
    assert [(r["table_name"], r["unverified"]) for r in integrity.unverified_fks(links).collect()] == [("u", 3)]


def test_semantic_types(frame):
    rows = [
        ("12", "1.5", "yes", "2024-01-31", "a.b@c.org", "+1 (555) 010-9999", "https://x.org/a", "0" * 8 + "-0000-0000-0000-" + "0" * 12, "word"),
        ("7", "-2.25", "F", "01/31/2024", "x@y.co", "555.010.99 99", "HTTP://y.de", "A" * 8 + "-BBBB-cccc-dddd-" + "e" * 12, "more"),
    ]
    names = ["integer", "float", "boolean", "date", "email", "phone", "url", "uuid", "string"]
    df = frame(", ".join(f"{n} string" for n in names), rows)
    got = {r["column_name"]: r["semantic_type"] for r in quality.semantic_types(df).collect()}
    # Phone numbers and UUIDs made of digits both count as phones; the UUID column has letters in one row.
    assert got == {n: n for n in names}


def test_semantic_type_needs_more_than_seven_tenths(frame):
    df = frame("c string", [("1",)] * 7 + [("x",)] * 3)
    row = quality.semantic_types(df).first()
    assert (row["semantic_type"], row["confidence"]) == ("string", 0.7)
    assert quality.semantic_types(df.union(frame("c string", [("2",)]))).first()["semantic_type"] == "integer"


def test_value_patterns(frame):
    df = frame(
        "a string, b string, c string, d string, e string, f string",
        [("abc", "x1", "prone", "a-b", "one", None), ("xyz", "long22", "pr", "c.dd", "three", None)],
    )
    got = {r["column_name"]: r["pattern"] for r in quality.value_patterns(df).collect()}
    assert got == {
        "a": "constant_length", "b": "numeric_suffix", "c": "prefix_pattern", "d": "contains_separators",
        "e": "variable", "f": "none",
    }


def test_classes(frame):
    rows = [(i, i % 50, i % 10, i % 3, i if i < 95 else None, i if i < 80 else None, i if i < 50 else None) for i in range(100)]
    df = frame(", ".join(f"c{i} int" for i in range(7)), rows)
    got = {r["column_name"]: r for r in quality.column_classes(df).collect()}
    assert [got[f"c{i}"]["cardinality_class"] for i in range(4)] == ["unique", "high", "medium", "low"]
    assert [got[f"c{i}"]["null_class"] for i in (0, 4, 5, 6)] == ["complete", "complete", "mostly_complete", "partial"]
    assert [got[f"c{i}"]["length_class"] for i in (0, 2, 3)] == ["similar_length", "fixed_length", "fixed_length"]


def test_classes_of_an_empty_table(frame):
    row = quality.column_classes(frame("a string", [])).first()
    assert tuple(row) == ("a", "empty", "empty", "empty", "empty", 0)


def test_content_classes(frame):
    df = frame("a string, b string, c string, d string, e string, f string",
               [("12", "a@b", "x" * 51, "short", "mixed text here", ""), ("7", "c@d", "y" * 60, "x", "no", None)])
    got = {r["column_name"]: r["content_class"] for r in quality.content_class(df).collect()}
    assert got == {"a": "numeric_id", "b": "email", "c": "long_text", "d": "short_code", "e": "general_text", "f": "empty"}


@pytest.mark.parametrize("days,label", [(6, "fresh"), (7, "moderate"), (29, "moderate"), (30, "stale")])
def test_freshness(frame, days, label):
    df = frame("ts timestamp_ntz", [(T0,), (T0 - dt.timedelta(days=90),)])
    assert quality.freshness(df, "ts", T0 + dt.timedelta(days=days)).first()["freshness"] == label


def test_quality_score(frame):
    df = frame("a string, b string", [("xx", " "), ("yy", None), ("zz", "w")])
    row = quality.quality_score(df).first()
    assert row["completeness"] == pytest.approx(4 / 6, abs=1e-6)
    assert row["consistency"] == 1.0
    one = quality.quality_score(frame("a string", [("x",), ("xxxxx",)])).first()
    assert one["consistency"] == pytest.approx(1 / (1 + 8 / 10), abs=1e-6)


def test_findings_filter_and_reports(frame):
    rows = [("a.x", "t", "k", "transaction_anomaly", "high", 0.8, 0.9), ("a.y", "t", "k", "temporal_anomaly", "critical", 0.9, 0.95),
            ("a.z", "t", "k", "temporal_anomaly", "low", 0.5, 0.7)]
    found = frame("finding_id string, table_name string, kind string, category string, risk_level string, "
                  "likelihood double, confidence double", rows)
    score = f.risk_score(found).first()
    miss = (1 - 0.75 * 0.8 * 0.9) * (1 - 0.9 * 0.95) * (1 - 0.25 * 0.5 * 0.7)
    assert score["overall_risk_score"] == pytest.approx(1 - miss, abs=1e-6) and score["risk_band"] == "CRITICAL"
    assert [r["finding_id"] for r in f.top_risks(found).collect()] == ["a.y", "a.x", "a.z"]
    top = {r["category"]: r["highest_risk"] for r in f.risk_breakdown(found).collect()}
    assert top == {"all": "critical", "temporal_anomaly": "critical", "transaction_anomaly": "high"}
    empty = f.risk_score(found.limit(0)).first()
    assert tuple(empty) == (0, 0.0, "LOW")


def test_findings_on_a_bad_table(frame):
    rows = [(i, 1, 500.0, T0 - dt.timedelta(seconds=i), T0 - dt.timedelta(days=1)) for i in range(20)]
    df = frame("id bigint, user bigint, amount double, ts timestamp_ntz, upd timestamp_ntz", rows)
    roles = f.Roles(df, amount="amount", ts="ts", user="user", created="ts", updated="upd", key=["user"],
                    duplicate_of=["amount", "user"])
    kinds = {r["kind"] for r in f.findings({"bad": roles}).collect()}
    assert kinds == {"round_amount_fraud", "velocity_fraud", "timestamp_tampering", "duplicate_key", "duplicate_transactions"}
    only = f.findings({"bad": roles}, ["temporal_anomaly"], 0.9, "critical").collect()
    assert [r["kind"] for r in only] == ["timestamp_tampering"]


def test_cardinality_and_selectivity(frame):
    one = frame("k bigint", [(1,), (2,), (3,)])
    many = frame("k bigint", [(1,), (1,), (2,), (None,)])
    label = lambda a, b: relate.cardinality(a, "k", b, "k").first()["cardinality"]
    assert [label(one, one), label(one, many), label(many, one), label(many, many)] == ["1:1", "1:many", "many:1", "many:many"]
    row = relate.join_selectivity(one, "k", many, "k").first()
    assert (row["matches"], row["selectivity"]) == (3, 0.25)


def test_name_candidates(frame):
    t = {
        "users": frame("id bigint, name string", []),
        "order": frame("id bigint, user_id bigint, orders_id bigint, ghost_id bigint", []),
    }
    pairs = relate.candidate_pairs(t, {"users": "id", "order": "id"})
    assert ("order", "user_id", "users", "id") in pairs and ("order", "ghost_id", None, None) in pairs


def test_statement_audit(frame):
    rows = ["SELECT created_at, updated_at FROM t", "  with a as (select 1) select * from a", "DELETE FROM t",
            "SELECT 1; drop table t", "EXPLAIN SELECT 1", None, "select executed from t"]
    got = [r["rule"] for r in usage.audit_statements(frame("s string", [(r,) for r in rows]), "s").collect()]
    assert got == ["ok", "ok", "delete", "drop", "not_a_select", "empty", "ok"]


def test_evict_plan(frame):
    rows = [(i, T0 + dt.timedelta(hours=7 * i), 100) for i in range(20)]
    df = frame("id bigint, ts timestamp_ntz, size bigint", rows)
    kept = lambda needed: sorted(r["id"] for r in usage.evict_plan(df, "ts", "id", "size", needed).collect())
    # 1.25 * 400 = 500 is met by five entries, 1.25 * 404 = 505 needs a sixth.
    assert kept(400) == list(range(5))
    assert kept(404) == list(range(6))
    assert kept(10**9) == list(range(20))
    assert kept(0) == []


def test_alerts(frame):
    rows = [(1, T0, 10.0), (2, T0 + dt.timedelta(days=1), 14.0), (3, T0 + dt.timedelta(days=2), 15.0)]
    df = frame("id bigint, ts timestamp_ntz, d double", rows)
    got = {(r["alert"], r["subject"]) for r in usage.alerts(df, "ts", "id", "d", slow=14.5).collect()}
    assert got == {("slow_entry", "3"), ("rising_mean", "2024-03-02")}


def test_search_and_page(frame):
    df = frame("id bigint, a string, v double", [(1, "Alpha", None), (2, "beta", 2.0), (3, "ALPHABET", 1.0), (4, None, 9.0)])
    out = lambda asc, page: [r["id"] for r in q.search_sort_page(df, "alpha", "v", asc, page, 1, "id").collect()]
    assert (out(True, 1), out(True, 2), out(False, 1), out(False, 3)) == ([3], [1], [3], [])


def test_inactive_since(frame):
    dim = frame("k bigint", [(1,), (2,), (3,)])
    log = frame("k bigint, ts timestamp_ntz", [(1, T0), (2, T0 - dt.timedelta(days=40))])
    assert sorted(r["k"] for r in q.inactive_since(dim, log, "k", "k", "ts", 30).collect()) == [2, 3]


def test_sums_keep_small_and_large_values(frame):
    tiny = frame("k string, v double", [("a", x) for x in (0.0, 1e-5, 2e-5, 3e-5)])
    row = q.cohort_compare(tiny, F.lit(True), "v").first()
    assert row["total"] == pytest.approx(6e-5) and row["avg_value"] == pytest.approx(1.5e-5)
    big = frame("k string, v double", [("a", 1e15), ("a", 1e-6)])
    assert q.scalar_agg(big, "sum", "v").first()["value"] == 1e15
    whole = frame("k string, v bigint", [("a", 4 * 10**17), ("a", 3)])
    assert q.scalar_agg(whole, "sum", "v").first()["value"] == 4 * 10**17 + 3


def test_amounts_are_judged_as_they_are(frame):
    df = frame("v double", [(9.996,), (0.004,), (1e15,), (100.00001,), (250.0,)])
    digits = {r["digit"]: r["frequency"] for r in statistical.benford_distribution(df, "v").collect()}
    assert digits == {"9": 1, "1": 2, "2": 1}
    assert transactions.round_ratio(frame("v double", [(100.00001,), (200.0,)]), "v").first()["round_small"] == 1


def test_row_hash_and_content_fingerprint(frame):
    def prints(schema, rows):
        return tuple(fingerprint.content_fingerprint(frame(schema, rows)).first())

    two = "a string, b string"
    assert prints(two, [("a|b", "c")]) != prints(two, [("a", "b|c")])
    assert prints(two, [(None, "c")]) != prints(two, [("\\N", "c")]) != prints(two, [("-", "c")])
    assert prints(two, [("x", "y"), ("p", None)]) == prints(two, [("p", None), ("x", "y")])
    nested = "a string, b array<int>, c map<string,int>"
    assert prints(nested, [("x", [1, 2], {"k": 1})]) != prints(nested, [("x", [1, 3], {"k": 1})])
    assert prints(nested, [("x", None, {"k": 1})]) != prints(nested, [("x", [], {"k": 1})])


def test_profiles_see_nested_columns_and_empty_kinds(frame):
    df = frame("a array<int>, s struct<x:int>, t string", [([1], (1,), "p"), ([1], None, "q"), (None, (2,), "q")])
    counts = {r["column_name"]: (r["distinct_count"], r["null_count"]) for r in profile.column_counts(df).collect()}
    assert counts == {"a": (1, 1), "s": (2, 1), "t": (2, 0)}
    assert {r["column_name"]: r["missing"] for r in profile.missing_values(df).collect()} == {"a": 1, "s": 1, "t": 0}
    for empty in (profile.numeric_range(df), profile.temporal_range(df), profile.numeric_summary(df)):
        assert empty.count() == 0 and "column_name" in empty.columns
    assert relate.discover_relationships({"x": df}, {}).count() == 0
    assert findings.findings({"x": findings.Roles(df)}).count() == 0


def test_findings_of_the_further_kinds(frame):
    rows = [(i, i % 3 + 1, "u", T0.replace(hour=23), 9500.0, None) for i in range(1, 4)]
    df = frame("id long, next_id long, user_id string, ts timestamp_ntz, v double, created_by string", rows)
    roles = findings.Roles(df, amount="v", ts="ts", user="user_id", key=["id"], ref="next_id", clock="ts", audit=["created_by"])
    got = {r["kind"]: (r["affected_rows"], r["risk_level"]) for r in findings.findings({"t": roles}).collect()}
    assert got["split_transactions"] == (1, "critical") and got["off_hours_transactions"] == (3, "medium")
    assert got["missing_audit_fields"] == (3, "high") and got["circular_references"] == (1, "medium")
    loose = findings.Roles(frame("a_id long, b_id long, c_id long", [(1, 2, 3)]), check_references=True)
    assert [r["kind"] for r in findings.findings({"t": loose}).collect()] == ["missing_foreign_key_constraints"]


def test_orphans_by_one_rule(frame):
    child, parent = frame("id long, p long", [(1, 1), (2, None), (3, 9)]), frame("p long", [(1,)])
    assert [r["id"] for r in integrity.orphan_rows(child, parent, "p", "p", "id").collect()] == [3]
    assert integrity.orphan_counts("c", child, [("p", "parent", parent, "p")]).first()["orphan_count"] == 1


def test_spans_ignore_clock_changes(spark, frame):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = spark.sql("SELECT timestamp_ntz'2024-03-31 01:30:00' AS a, timestamp_ntz'2024-03-31 03:30:00.000001' AS b")
        assert df.select((micros("b") - micros("a")).alias("d")).first()["d"] == 2 * 3600 * 10**6 + 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
