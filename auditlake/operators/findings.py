"""One table of findings over many tables, and what is reported from it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.exprs import (
    RISK_RANK, as_datetime, as_double, count_if, mean_of, no_rows, ratio, risk_rank, ts_lit,
)
from auditlake.operators import integrity, statistical, temporal, transactions

# Likelihood and confidence of each verdict.
VERDICTS = {
    "duplicate_transactions": ("transaction_anomaly", 0.8, 0.9),
    "round_amount_fraud": ("transaction_anomaly", 0.6, 0.85),
    "velocity_fraud": ("transaction_anomaly", 0.75, 0.9),
    "backdated_records": ("temporal_anomaly", 0.7, 0.85),
    "future_dated_records": ("temporal_anomaly", 0.5, 0.8),
    "timestamp_tampering": ("temporal_anomaly", 0.9, 0.95),
    "benfords_law_violation": ("statistical_anomaly", 0.5, 0.7),
    "statistical_outliers": ("statistical_anomaly", 0.5, 0.7),
    "orphaned_records": ("relationship_integrity", 0.5, 0.7),
    "duplicate_key": ("schema_vulnerability", 0.5, 0.7),
    "critical_field_allows_null": ("schema_vulnerability", 0.5, 0.7),
    "split_transactions": ("transaction_anomaly", 0.5, 0.7),
    "off_hours_transactions": ("transaction_anomaly", 0.5, 0.7),
    "missing_audit_fields": ("data_quality", 0.5, 0.7),
    "missing_foreign_key_constraints": ("schema_vulnerability", 0.5, 0.7),
    "circular_references": ("relationship_integrity", 0.5, 0.7),
}
MIN_CONFIDENCE, MIN_RISK = 0.7, "medium"
# Score bands. The level weights are ours.
SCORE_BANDS = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM")]
LEVEL_WEIGHT = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}


@dataclass
class Roles:
    """A table and which of its columns play which part; unset roles skip their detectors."""

    df: DataFrame
    amount: str | None = None
    ts: str | None = None
    user: str | None = None
    created: str | None = None
    updated: str | None = None
    key: list[str] = field(default_factory=list)
    duplicate_of: list[str] = field(default_factory=list)
    measures: list[str] = field(default_factory=list)
    critical: list[str] = field(default_factory=list)
    fks: list[tuple[str, str, DataFrame, str]] = field(default_factory=list)
    clock: str | None = None
    audit: list[str] = field(default_factory=list)
    ref: str | None = None
    check_references: bool = False
    as_of: dt.datetime | str | None = None
    round_modulus: int = 100
    velocity_window: dt.timedelta = dt.timedelta(hours=1)
    velocity_min: int = transactions.VELOCITY_MIN_ROWS


FINDING = (
    "finding_id string, table_name string, kind string, category string, risk_level string, likelihood double, "
    "confidence double, affected_columns array<string>, affected_rows bigint, statistic double"
)


def _finding(table: str, kind: str, columns: list[str], risk: Column | str, rows: Column, stat: Column) -> Column:
    category, likelihood, confidence = VERDICTS[kind]
    return F.struct(
        F.concat(F.lit(f"{table}.{'+'.join(columns)}."), F.lit(kind)).alias("finding_id"),
        F.lit(table).alias("table_name"),
        F.lit(kind).alias("kind"),
        F.lit(category).alias("category"),
        (F.lit(risk) if isinstance(risk, str) else risk).alias("risk_level"),
        F.lit(likelihood).alias("likelihood"),
        F.lit(confidence).alias("confidence"),
        F.array(*[F.lit(c) for c in columns]).alias("affected_columns"),
        rows.cast("bigint").alias("affected_rows"),
        stat.cast("double").alias("statistic"),
    )


def _first_look(t: Roles) -> tuple[Roles, dict[str, tuple[float | None, float | None]]]:
    """What the verdicts are measured by, in one scan: the last time, and the moments of the measures."""
    kinds = [F.lit(1).alias("_one")]
    now = t.ts or t.created
    if now and t.as_of is None:
        kinds.append(F.max(now).alias("_now"))
    for i, c in enumerate(t.measures):
        kinds += [F.avg(c).alias(f"_m{i}"), F.nullif(F.stddev_samp(c), F.lit(0.0)).alias(f"_s{i}")]
    row = t.df.agg(*kinds).first().asDict() if len(kinds) > 1 else {}
    if now:
        last = t.as_of if t.as_of is not None else row["_now"]
        t = replace(t, as_of=None if last is None else as_datetime(last))
    return t, {c: (row[f"_m{i}"], row[f"_s{i}"]) for i, c in enumerate(t.measures)}


def _scan_findings(name: str, t: Roles, moments: dict[str, tuple[float | None, float | None]]) -> DataFrame | None:
    """Every verdict that is a sum over rows: one aggregate, one scan."""
    aggs: list[Column] = []
    out: list[Column] = []
    none = F.lit(None)
    df = t.df

    if t.amount:
        value = F.col(t.amount)
        aggs += [F.count(t.amount).alias("_amounts"), count_if(value % t.round_modulus == 0).alias("_round")]
        share = F.coalesce(ratio(F.col("_round") * 100, F.col("_amounts")), F.lit(0.0))
        risk = F.when(share < transactions.ROUND_HIGH_PERCENT, "medium").otherwise("high")
        out.append(
            F.when(
                share > transactions.ROUND_FLAG_PERCENT,
                _finding(name, "round_amount_fraud", [t.amount], risk, F.col("_round"), as_double(share)),
            )
        )
        df = df.withColumn("_digit", F.when(F.col(t.amount) > 0, statistical.first_digit(t.amount)))
        digits = list(statistical.BENFORD_PERCENT)
        aggs += [count_if(F.col("_digit") == g).alias(f"_digit{g}") for g in digits]
        seen = [F.col(f"_digit{g}") for g in digits]
        tested = reduce(lambda a, b: a + b, seen)
        present = reduce(lambda a, b: a + b, [(s > 0).cast("int") for s in seen])
        terms = []
        for g, s in zip(digits, seen):
            e = F.nullif(F.lit(statistical.BENFORD_PERCENT[g]) * tested / 100.0, F.lit(0.0))
            # Digits that do not occur are left out of the statistic.
            terms.append(F.when(s > 0, (s - e) * (s - e) / e).otherwise(0.0))
        chi = reduce(lambda a, b: a + b, terms)
        risk = F.when(chi < statistical.BENFORD_HIGH, "medium").otherwise("high")
        out.append(
            F.when(
                (present >= statistical.BENFORD_MIN_DIGITS) & (chi > statistical.BENFORD_CRITICAL),
                _finding(name, "benfords_law_violation", [t.amount], risk, tested, as_double(chi)),
            )
        )
    if t.ts or t.created:
        now = t.as_of
        if now is not None and t.created:
            kind = t.df.schema[t.created].dataType
            old = ts_lit(now - dt.timedelta(days=temporal.BACKDATED_DAYS), kind)
            limit = ts_lit(now - dt.timedelta(days=temporal.BACKDATED_MAX_DAYS), kind)
            aggs.append(count_if((F.col(t.created) < old) & (F.col(t.created) > limit)).alias("_back"))
            out.append(
                F.when(
                    F.col("_back") > temporal.BACKDATED_MIN_ROWS,
                    _finding(name, "backdated_records", [t.created], "high", F.col("_back"), none),
                )
            )
        if now is not None and t.ts:
            at = ts_lit(now, t.df.schema[t.ts].dataType)
            aggs.append(count_if(F.col(t.ts) > at).alias("_future"))
            out.append(
                F.when(
                    F.col("_future") > temporal.FUTURE_MIN_ROWS,
                    _finding(name, "future_dated_records", [t.ts], "medium", F.col("_future"), none),
                )
            )
    if t.created and t.updated:
        aggs.append(count_if(F.col(t.updated) < F.col(t.created)).alias("_tampered"))
        out.append(
            F.when(
                F.col("_tampered") > 0,
                _finding(
                    name, "timestamp_tampering", [t.created, t.updated], "critical", F.col("_tampered"), none
                ),
            )
        )
    if t.clock:
        aggs.append(count_if(transactions.in_night(t.clock)).alias("_night"))
        out.append(F.when(F.col("_night") > 0, _finding(name, "off_hours_transactions", [t.clock], "medium", F.col("_night"), none)))
    if t.audit:
        gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in t.audit])
        aggs += [count_if(gap).alias("_gaps"), F.count("*").alias("_rows")]
        share = as_double(ratio(F.col("_gaps") * 100, F.col("_rows")))
        out.append(F.when(F.col("_gaps") > 0, _finding(name, "missing_audit_fields", t.audit, "high", F.col("_gaps"), share)))
    if t.check_references:
        known = {column for column, *_ in t.fks} | set(t.key)
        loose = [f.name for f in t.df.schema.fields if integrity.is_reference_like(f) and f.name not in known]
        if len(loose) > integrity.UNVERIFIED_MIN:
            aggs.append(F.count("*").alias("_referring"))
            out.append(_finding(name, "missing_foreign_key_constraints", loose, "medium", F.col("_referring"), F.lit(len(loose))))
    for i, c in enumerate(t.critical):
        aggs.append(count_if(F.col(c).isNull()).alias(f"_null{i}"))
        out.append(
            F.when(
                F.col(f"_null{i}") > 0,
                _finding(name, "critical_field_allows_null", [c], "medium", F.col(f"_null{i}"), none),
            )
        )
    real = lambda x: F.lit(None if x is None else float(x)).cast("double")
    aggs += statistical.outlier_counts(t.measures, [real(moments[c][0]) for c in t.measures], [real(moments[c][1]) for c in t.measures])
    for i, c in enumerate(t.measures):
        z = F.col(f"_z{i}")
        risk = statistical.outlier_risk(z["outlier_count"], z["total_count"])
        out.append(F.when(risk != "none", _finding(name, "statistical_outliers", [c], risk, z["outlier_count"], z["max_z_score"])))
    if not out:
        return None
    return df.agg(*aggs).select(F.inline(F.array_compact(F.array(*out))))


def _group_findings(name: str, t: Roles) -> list[DataFrame]:
    """Verdicts that need groups or a second table."""
    none = F.lit(None)
    frames = []

    def count_rows(df: DataFrame, kind: str, columns: list[str], risk: str) -> DataFrame:
        row = df.agg(F.count("*").alias("_n")).filter(F.col("_n") > 0)
        return row.select(F.inline(F.array(_finding(name, kind, columns, risk, F.col("_n"), none))))

    if t.duplicate_of:
        frames.append(
            count_rows(
                transactions.duplicates(t.df, t.duplicate_of), "duplicate_transactions", t.duplicate_of, "high"
            )
        )
    if t.user and t.ts and t.as_of is not None:
        fast = transactions.fast_users(t.df, t.user, t.ts, t.velocity_window, t.velocity_min, t.as_of)
        frames.append(count_rows(fast, "velocity_fraud", [t.user, t.ts], "high"))
    if t.user and t.ts and t.amount:
        split = transactions.structuring(t.df, t.user, t.ts, t.amount)
        frames.append(count_rows(split, "split_transactions", [t.user, t.amount], "critical"))
    if t.ref and t.key:
        frames.append(count_rows(integrity.cycles(t.df, t.key[0], t.ref), "circular_references", [t.key[0], t.ref], "medium"))
    if t.key:
        frames.append(count_rows(integrity.key_violations(t.df, t.key), "duplicate_key", t.key, "high"))
    if t.fks:
        lost = integrity.orphan_counts(name, t.df, t.fks)
        hits = [
            F.when(F.col("child_column") == c, _finding(name, "orphaned_records", [c], F.col("risk_level"), F.col("orphan_count"), none))
            for c in dict.fromkeys(column for column, *_ in t.fks)
        ]
        frames.append(lost.filter(F.col("orphan_count") > 0).select(F.inline(F.array_compact(F.array(*hits)))))
    return frames


def findings(
    tables: dict[str, Roles],
    categories: list[str] | None = None,
    min_confidence: float = MIN_CONFIDENCE,
    min_risk: str = MIN_RISK,
) -> DataFrame:
    """Run the detectors each table has roles for; one row per verdict that fires.

    A table is read twice for all verdicts on single rows and values (what they are
    measured by, then the verdicts), once for all its references, and once for
    each verdict on groups.
    """
    if not tables:
        return no_rows(SparkSession.active().range(0), FINDING)
    frames = []
    for name, t in tables.items():
        t, moments = _first_look(t)
        scan = _scan_findings(name, t, moments)
        frames += ([scan] if scan is not None else []) + _group_findings(name, t)
    if not frames:
        return no_rows(next(iter(tables.values())).df, FINDING)
    found = reduce(DataFrame.unionByName, frames)
    keep = (F.col("confidence") >= min_confidence) & (risk_rank("risk_level") >= RISK_RANK[min_risk])
    if categories:
        keep = keep & F.col("category").isin(categories)
    return found.filter(keep)


def risk_breakdown(found: DataFrame) -> DataFrame:
    """Findings per level, for each category and for all; with the highest level."""
    levels = list(reversed(RISK_RANK))
    rows = found.rollup("category").agg(
        F.count("*").alias("total"),
        *[count_if(F.col("risk_level") == level).alias(level) for level in levels],
        F.max(risk_rank("risk_level")).alias("_top"),
    )
    top = F.lit("none")
    for level, rank in RISK_RANK.items():
        top = F.when(F.col("_top") == rank, level).otherwise(top)
    return rows.withColumn("highest_risk", top).withColumn("category", F.coalesce("category", F.lit("all"))).drop("_top")


def risk_score(found: DataFrame) -> DataFrame:
    """Chance that at least one finding is real, weighted by level, and its band."""
    weight = F.lit(0.0)
    for level, w in LEVEL_WEIGHT.items():
        weight = F.when(F.col("risk_level") == level, w).otherwise(weight)
    miss = F.greatest(1.0 - weight * F.col("likelihood") * F.col("confidence"), F.lit(1e-12))
    row = found.agg(
        F.count("*").alias("findings"), (1.0 - F.exp(F.coalesce(F.sum(F.log(miss)), F.lit(0.0)))).alias("_s")
    )
    band = F.lit("LOW")
    for limit, label in reversed(SCORE_BANDS):
        band = F.when(F.col("_s") >= limit, label).otherwise(band)
    return row.select("findings", as_double("_s").alias("overall_risk_score"), band.alias("risk_band"))


def top_risks(found: DataFrame, k: int = 3) -> DataFrame:
    """The k findings that rank highest by level, then likelihood."""
    return (
        found.orderBy(F.desc(risk_rank("risk_level")), F.desc("likelihood"), F.col("finding_id"))
        .limit(k)
        .select("finding_id", "kind", "category", "risk_level", "likelihood")
    )


def run_stats(log: DataFrame, ok: Column, duration: str, ts: str, key: str, recent: int = 10) -> DataFrame:
    """Totals and mean time of a run log, with the last entries."""
    last = (
        log.orderBy(F.col(ts).desc(), F.col(key).desc())
        .limit(recent)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(ts, key))), lambda e: e[key]).alias("_r"))
        .scalar()
    )
    row = log.agg(
        F.count("*").alias("total_runs"),
        count_if(ok).alias("successful_runs"),
        count_if(~ok).alias("failed_runs"),
        mean_of(duration).alias("avg_time"),
    )
    return row.withColumn("recent", last)
