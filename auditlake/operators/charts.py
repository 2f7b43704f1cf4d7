"""Aggregations a chart is drawn from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from auditlake.functions.exprs import as_double, count_if, kind_of, melt, micros, ratio, total_of
from auditlake.functions.ordering import exact_quantiles, next_value
from auditlake.session import shuffle_width


def series_matrix(df: DataFrame, label: str, series: str, measure: str, values: list[str]) -> DataFrame:
    """Labels down, series across; cells without rows are 0. The series are named, so no extra pass."""
    cells = df.groupBy(label).pivot(series, values).agg(total_of(measure, kind_of(df, measure)))
    return cells.fillna(0.0, subset=[str(v) for v in values])


def shares(df: DataFrame, label: str, measure: str) -> DataFrame:
    """Total per label and its share of the whole."""
    totals = df.groupBy(label).agg(total_of(measure, kind_of(df, measure)).alias("total"))
    # A sum over the grouped rows: Spark reads their shuffle twice, not the table, and no task holds all labels.
    whole = totals.agg(F.sum("total").alias("w")).scalar()
    return totals.withColumn("share", as_double(ratio(F.col("total") * 100, whole)))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, empty bins included."""
    span = df.agg(
        F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    ).scalar()
    value = F.col(col).cast("double")
    bounded = df.filter(F.col(col).isNotNull()).select(value.alias("_v"), span.alias("_s"))
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    place = F.least(
        F.when(width > 0, F.floor((F.col("_v") - F.col("_s.lo")) / width)).otherwise(0), F.lit(bins - 1)
    )
    counts = bounded.groupBy(place.cast("bigint").alias("bin")).agg(F.count("*").alias("_n"))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("_s", span)
    return frame.join(counts, "bin", "left").select(
        "bin",
        as_double(F.col("_s.lo") + width * F.col("bin")).alias("low"),
        as_double(F.col("_s.lo") + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"),
    )


def heatmap(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.count("*").alias("n"))


def box(df: DataFrame, key: str, col: str) -> DataFrame:
    """Smallest, quartiles and largest value per group; exact."""
    ends = df.filter(F.col(col).isNotNull()).groupBy(key).agg(
        F.min(col).cast("double").alias("min_value"), F.max(col).cast("double").alias("max_value")
    )
    middle = exact_quantiles(df, [key], col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    same = ends[key].eqNullSafe(middle[key])
    return ends.join(middle, same).select(ends[key], "min_value", "q1", "median", "q3", "max_value")


def hierarchy(df: DataFrame, levels: list[str], measure: str) -> DataFrame:
    """Totals at every level of a hierarchy, with the depth of each row."""
    rows = df.rollup(*levels).agg(
        total_of(measure, kind_of(df, measure)).alias("total"), F.count("*").alias("n"), F.grouping_id().alias("_g")
    )
    depth = reduce(
        lambda a, i: F.when(F.col("_g") == (1 << i) - 1, len(levels) - i).otherwise(a),
        range(len(levels) + 1),
        F.lit(None),
    )
    return rows.withColumn("depth", depth.cast("bigint")).drop("_g")


def flows(df: DataFrame, entity: str, ts: str, key: str, state: str) -> DataFrame:
    """How often one state follows another within an entity."""
    steps = df.select(entity, ts, key, state)
    following = next_value(steps, [entity], [F.col(ts), F.col(key)], state, "_to")
    return (
        following.filter(F.col("_to").isNotNull())
        .groupBy(F.col(state).alias("from_state"), F.col("_to").alias("to_state"))
        .agg(F.count("*").alias("n"))
    )


def funnel(df: DataFrame, entity: str, ts: str, state: str, steps: list[str]) -> DataFrame:
    """Entities that reach each step after the steps before it, each strictly later than the one before.

    Rows are split by ranges of (entity, time). A stretch of an entity's rows says,
    for each number of steps done before it, how many are done after it; these
    answers are put together in order of time. So one shuffle moves the rows, an
    entity with most rows is spread over many tasks, and nothing is joined. Rows
    without an entity or a time count for nothing.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = list(dict.fromkeys(steps))
    number = reduce(lambda a, i: F.when(F.col(state) == names[i], i).otherwise(a), range(len(names)), F.lit(None).cast("int"))
    rows = df.filter(F.col(state).isin(names) & F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(entity).alias("_e"), micros(ts).alias("_t"), number.cast("int").alias("_s")
    )
    wanted = [names.index(s) for s in steps]

    def stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Per entity of a sorted batch: its first time, and the steps done after it for 0, 1, ... done before."""
        e, t, s = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        n = len(t)
        begins = np.concatenate(([True], pc.not_equal(e.slice(1), e.slice(0, n - 1)).to_numpy(zero_copy_only=False)))
        own = np.cumsum(begins) - 1
        # Times as ranks, so that (entity, time) is one number.
        moment = np.unique(t, return_inverse=True)[1]
        base = n + 1
        key = own * base + moment + 1
        at_step = [key[s == w] for w in wanted]
        first = np.flatnonzero(begins)
        ends = np.empty((len(first), len(wanted) + 1), np.int32)
        ends[:, len(wanted)] = len(wanted)
        for done in range(len(wanted)):
            here = np.arange(len(first)) * base  # before any time of the entity
            reached = np.full(len(first), done, np.int32)
            alive = np.ones(len(first), bool)
            for j in range(done, len(wanted)):
                spot = np.searchsorted(at_step[j], here, "right")
                found = np.append(at_step[j], np.iinfo(np.int64).max)[spot]
                alive &= found < (np.arange(len(first)) + 1) * base
                reached[alive] = j + 1
                here = np.where(alive, found, here)
            ends[:, done] = reached
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * (len(wanted) + 1)), pa.array(ends.ravel()))
        return pa.RecordBatch.from_arrays([e.take(pa.array(first)), pa.array(t[first]), lists], names=["_e", "_t", "_ends"])

    def walk(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # Rows of one entity and time stay together: the last such rows wait for the next batch.
            t, e = batch.column(1).to_numpy(), batch.column(0)
            last = (t == t[-1]) & pc.equal(e, e[-1]).to_numpy(zero_copy_only=False)
            cut = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            held = batch.slice(cut)
            if cut:
                yield stretches(batch.slice(0, cut))
        if held is not None:
            yield stretches(held)

    width = shuffle_width(df.sparkSession)
    # Equal (entity, time) are in one range, so a stretch is strictly later than the one before.
    ordered = rows.repartitionByRange(width, "_e", "_t").sortWithinPartitions("_e", "_t")
    schema = StructType([rows.schema["_e"]]).add("_t", "long").add("_ends", ArrayType(IntegerType()))
    parts = ordered.mapInArrow(walk, schema)
    # As many stretches per entity as batches hold its rows.
    done = parts.groupBy("_e").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("_t", "_ends"))), F.lit(0), lambda k, p: F.element_at(p["_ends"], k + 1)).alias("_k")
    )
    counts = done.agg(*[count_if(F.col("_k") >= i + 1).alias(f"_n{i}") for i in range(len(steps))])
    share = lambda i: as_double(ratio(F.col(f"_n{i}"), F.col("_n0"))).alias("share")
    return melt(
        counts,
        [
            F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(s).alias("state"), F.col(f"_n{i}").alias("entities"), share(i))
            for i, s in enumerate(steps)
        ],
    )
