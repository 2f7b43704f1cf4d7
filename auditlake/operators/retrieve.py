"""Vector search: one query, many queries, and an approximate join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.functions.exprs import no_rows
from auditlake.functions.inverted import learn, list_order, nearest_lists
from auditlake.functions.vectors import block_kernel
from auditlake.session import materialize

# More queries than this are not held by every task; they are joined in blocks instead.
QUERY_ROWS_IN_TASK = 4096
QUERY_BLOCK, CORPUS_BLOCK = 16_384, 20_000
#: Lists of an inverted file: the root of the corpus, up to this many.
MOST_LISTS = 16_384
#: Queries whose true neighbours tell how many lists to visit, and the share of them to be found.
CALIBRATING, PERCENT_FOUND = 256, 95


def knn(
    df: DataFrame,
    vec: list[float],
    k: int,
    metric: str = "cosine",
    key: str = "vec_id",
    emb: str = "embedding",
    min_d: float | None = None,
    max_d: float | None = None,
    filters: Column | None = None,
) -> DataFrame:
    """The k rows nearest to one vector; ties by key.

    Distances are taken batch-wise over Arrow buffers; a task passes on its k
    best rows, so nothing but the top-k merge leaves it.
    """
    rows = df if filters is None else df.filter(filters)
    rows = rows.filter(F.size(emb) == len(vec))
    names = [c for c in df.columns if c != emb]
    schema = StructType([df.schema[c] for c in names]).add("distance", "double")
    query = [float(x) for x in vec]

    def nearest(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        q = np.array(query)
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            c = c.reshape(batch.num_rows, len(q)).astype("float64")
            if metric == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = 1.0 - (c @ q) / (np.sqrt((c * c).sum(axis=1)) * np.sqrt(q @ q))
            else:
                d = ((c - q) ** 2).sum(axis=1)
            d = np.round(d, 6) + 0.0
            ok = ~np.isnan(d)
            if min_d is not None:
                ok &= d >= min_d
            if max_d is not None:
                ok &= d <= max_d
            found = pa.Table.from_batches([batch]).drop_columns([emb])
            found = found.append_column("distance", pa.array(d)).filter(pa.array(ok))
            best = found if best is None else pa.concat_tables([best, found])
            if best.num_rows > k:
                best = best.take(pc.sort_indices(best, [("distance", "ascending"), (key, "ascending")])[:k])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    return rows.select(emb, *names).mapInArrow(nearest, schema).orderBy("distance", key).limit(k)


def _closest(pairs: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    ranked = pairs.withColumn("place", place).filter(F.col("place") <= k)
    return ranked.withColumn("place", F.col("place").cast("bigint"))


RESULT = "query_id bigint, item_id bigint, distance double"


def _in_task(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    """Every task holds all queries (their number is checked) and keeps k rows for each."""
    import numpy as np

    rows = queries.collect()
    qids = np.array([r["query_id"] for r in rows], dtype="int64")
    matrix = np.array([r["vec"] for r in rows], dtype="float64")
    shared = corpus.sparkSession.sparkContext.broadcast((qids, matrix))
    best = block_kernel(k, metric)

    def scan(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        ids, q = shared.value
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = best(ids, q, batch.column("item_id").to_numpy(), c)
            found = pd.DataFrame(dict(zip(("query_id", "item_id", "distance"), found)))
            kept = found if kept is None else pd.concat([kept, found])
            kept = kept.sort_values(["query_id", "distance", "item_id"]).groupby("query_id").head(k)
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept, preserve_index=False)

    return corpus.mapInArrow(scan, RESULT)


def _in_blocks(queries: DataFrame, corpus: DataFrame, k: int, metric: str, qblock: int, cblock: int) -> DataFrame:
    """Blocks of both sides that share a bucket meet in one group of bounded size.

    A bucket holding most rows is cut into many blocks; a group passes on k
    rows per query, never its pairs.
    """
    qn = queries.groupBy("bucket").agg(F.ceil(F.count("*") / qblock).alias("_nq"))
    cn = corpus.groupBy("bucket").agg(F.ceil(F.count("*") / cblock).alias("_nc"))
    # One row per bucket; the caller bounds the number of buckets.
    sizes = F.broadcast(qn.join(cn, "bucket"))
    cut = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = queries.join(sizes, "bucket").withColumn("_q", cut("query_id", "_nq")).withColumn("_c", every("_nc"))
    right = corpus.join(sizes, "bucket").withColumn("_c", cut("item_id", "_nc")).withColumn("_q", every("_nq"))
    best = block_kernel(k, metric)

    def meet(q, c):
        import numpy as np
        import pyarrow as pa

        def side(table, key):
            table = table.combine_chunks()
            flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return table.column(key).to_numpy(), flat.reshape(table.num_rows, -1)

        if q.num_rows and c.num_rows:
            found = best(*side(q, "query_id"), *side(c, "item_id"))
        else:
            found = ([], [], [])
        kinds = ("int64", "int64", "float64")
        return pa.table(
            [np.asarray(f, dtype=t) for f, t in zip(found, kinds)], names=["query_id", "item_id", "distance"]
        )

    on = ["bucket", "_q", "_c"]
    keep = lambda df, key: df.select(*on, key, "vec")
    return (
        keep(left, "query_id").groupBy(*on).cogroup(keep(right, "item_id").groupBy(*on)).applyInArrow(meet, RESULT)
    )


def _sides(
    queries: DataFrame, corpus: DataFrame, qid: str, cid: str, qemb: str, cemb: str
) -> tuple[DataFrame, DataFrame]:
    left = queries.select(F.col(qid).cast("bigint").alias("query_id"), F.col(qemb).cast("array<double>").alias("vec"))
    right = corpus.select(F.col(cid).cast("bigint").alias("item_id"), F.col(cemb).cast("array<double>").alias("vec"))
    return left.filter("size(vec) > 0"), right.filter("size(vec) > 0")


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    qid: str,
    cid: str,
    qemb: str = "embedding",
    cemb: str = "embedding",
    metric: str = "cosine",
    in_task: int = QUERY_ROWS_IN_TASK,
    qblock: int = QUERY_BLOCK,
    cblock: int = CORPUS_BLOCK,
) -> DataFrame:
    """Exact k nearest corpus rows for every query row."""
    left, right = _sides(queries, corpus, qid, cid, qemb, cemb)
    if left.limit(in_task + 1).count() <= in_task:
        return _closest(_in_task(left, right, k, metric), k)
    one = F.lit(0)
    pairs = _in_blocks(left.withColumn("bucket", one), right.withColumn("bucket", one), k, metric, qblock, cblock)
    return _closest(pairs, k)


def ann_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    qid: str,
    cid: str,
    dims: int,
    qemb: str = "embedding",
    cemb: str = "embedding",
    metric: str = "cosine",
    lists: int | None = None,
    probes: int | None = None,
    percent: int = PERCENT_FOUND,
    qblock: int = QUERY_BLOCK,
    cblock: int = CORPUS_BLOCK,
    per_list: int | None = None,
) -> DataFrame:
    """Approximate k nearest rows from an inverted file: a query is compared with the rows of its nearest lists.

    Every corpus row is in the list of its nearest centroid; the centroids are
    learnt on all rows, or on about ``per_list`` rows for each (``inverted.learn``). There are as many lists as the
    root of the corpus, ``MOST_LISTS`` at most, and larger lists are cut into
    blocks. How many lists a query visits is measured unless ``probes`` says it:
    so many that ``percent`` of the true neighbours of up to ``CALIBRATING`` queries
    are found. Vectors of other dimensions, and such as have no direction (zero,
    or not finite), are nobody's neighbours.
    """
    left, right = _sides(queries, corpus, qid, cid, qemb, cemb)
    usable = (F.size("vec") == dims) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if metric == "cosine":
        usable &= F.exists("vec", lambda x: x != 0)
    left, right = left.filter(usable), right.filter(usable)
    rows = right.count()
    lists = lists or min(MOST_LISTS, max(1, math.ceil(math.sqrt(rows))))
    centres = learn(right, lists, rows, metric, per_list=per_list)
    if not len(centres):
        return no_rows(queries, RESULT + ", place bigint")
    probes = min(probes or _measured(left, right, centres, k, metric, percent), len(centres))
    # Read by the plan twice: the sizes of the lists, and their rows.
    placed = materialize(nearest_lists(right, "item_id", centres, metric, 1))
    pairs = _in_blocks(nearest_lists(left, "query_id", centres, metric, probes), placed, k, metric, qblock, cblock)
    return _closest(pairs, k)


def _measured(left: DataFrame, right: DataFrame, centres, k: int, metric: str, percent: int) -> int:
    """The lists to visit, so that ``percent`` of the neighbours of some queries are found: at most ``CALIBRATING`` of them."""
    some = materialize(left.orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(CALIBRATING))
    if some.isEmpty():
        return 1
    # At most CALIBRATING * k rows from here on.
    true = materialize(_closest(_in_task(some, right, k, metric), k))
    wanted = F.broadcast(true.select("item_id").distinct())
    held = nearest_lists(right.join(wanted, "item_id", "left_semi"), "item_id", centres, metric, 1)
    homes = {r["item_id"]: r["bucket"] for r in held.select("item_id", "bucket").collect()}
    order = {r["query_id"]: list_order(r["vec"], centres, metric) for r in some.collect()}
    ranks = sorted(order[r["query_id"]].index(homes[r["item_id"]]) + 1 for r in true.collect())
    return ranks[(percent * len(ranks) + 99) // 100 - 1] if ranks else 1
