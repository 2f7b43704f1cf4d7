"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import scratch_path, shared_dir

#: A word: a run of code points other than the ASCII blanks (space, tab to carriage return).
WORD = "[^\\x20\\x09-\\x0D]+"
#: Labels are learnt from rows whose checksum of the id leaves another remainder than this.
HELD_OUT = 2


def held_out(doc_id: str) -> Column:
    """True for rows that no label may be learnt from. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def sized(text: str) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def write_once(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that all executors share."""
    assert shared_dir(spark)
    return scratch_path(spark, label)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, bound: int, seed: int
) -> DataFrame:
    """About ``bound`` labelled rows at most, as (text, y, part), held-out rows left out.

    Rows are chosen by a seeded hash of the id. ``part`` is 0 to 3 by another
    hash, for splits within the sample. Null labels, texts and ids are left out.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("_id").isNotNull() & F.col("y").isNotNull() & ~held_out("_id")
    )
    rows = max(1, known.count())
    share = min(1.0, bound / rows)
    picked = known.filter((F.xxhash64("_id", F.lit(seed)) % 1_000_000 + 1_000_000) % 1_000_000 < int(share * 1_000_000))
    # The sample is bounded by a parameter, so the small side may be sent to all tasks.
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")
    return joined.filter("text IS NOT NULL").select(
        "text", "y", F.expr(f"cast(pmod(xxhash64(_id, {seed + 1}), 4) as int)").alias("part")
    )


def batches(iterator: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes, so that long texts do not pile up."""
    for batch in iterator:
        if batch.num_rows == 0:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block, jobs hand Python at most so many rows at a time: for rows of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def give_back() -> None:
    """Freed memory of this worker goes back to the system, where the C library can say so.

    Workers stay between jobs; what they keep is missing in the executor's next stage.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
