"""Shards of uniformly shuffled records by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit in memory.
Pass two holds one bucket per task, shuffles it (Spark's ``shuffle`` is a
Fisher-Yates shuffle with a seed) and writes it. Buckets in order, one after the
other, are a uniform permutation of all records; shards are equal cuts of it,
so that their counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import work_dir
from auditlake.session import materialize


def write_shards(
    records: DataFrame, path: str, shards: int = 40, bucket_bytes: int = 24 << 20, size: str = "text", seed: int = 5
) -> DataFrame:
    """Write all records to ``path`` and return (shard, slot, record) as read from there.

    ``record`` is a struct of the columns of ``records``, so names cannot clash.
    ``slot`` counts from 0 in each shard. ``size`` names the column whose bytes
    dominate; buckets are planned by it. Null values and empty texts are records
    like any other. Equal rows stay separate records; where a row has more copies
    than a part of a bucket holds, the copies are counted, numbered and scattered by
    their numbers. An empty table writes no record; with fewer records than shards
    some shards are empty.
    """
    spark = records.sparkSession
    hashed = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record"))
    hashed = hashed.withColumn("h", F.xxhash64(F.lit(seed), "record"))
    weight = F.coalesce(F.octet_length(F.col("record")[size].cast("string")), F.lit(0)) + 64
    total, rows = hashed.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-int(total) // bucket_bytes))
    hashed = _scattered_copies(hashed.withColumn("w", weight), seed, bucket_bytes).drop("w")
    placed = hashed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    # One row per bucket: where it starts. It travels with the bucket, so no join is needed.
    starts = placed.groupBy("bucket").agg(F.count("*").alias("n")).select(
        F.lit(None).cast(hashed.schema["record"].dataType).alias("record"),
        F.lit(None).cast("long").alias("h"),
        "bucket",
        (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"),
    )
    scattered = placed.withColumn("start", F.lit(None).cast("long")).unionByName(starts)
    held = (
        scattered.repartitionById(buckets, "bucket")
        .sortWithinPartitions("bucket", "h")
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("records"), F.max("start").alias("start"))
    )
    # A partition is one bucket, so seed and partition number fix its permutation.
    shuffled = held.select("start", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record"))
    place = F.col("start") + F.col("at")
    shard = F.expr(f"cast((start + at) * {shards} div {max(1, rows)} as int)")
    out = shuffled.select(shard.alias("shard"), place.alias("place"), "record").select(
        "shard",
        (F.col("place") - F.expr(f"(shard * cast({rows} as bigint) + {shards - 1}) div {shards}")).alias("slot"),
        "record",
    )
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    schema = StructType().add("slot", "long").add("record", hashed.schema["record"].dataType).add("shard", "integer")
    return spark.read.schema(schema).parquet(path).select("shard", "slot", "record")


def _scattered_copies(hashed: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """``hashed`` with a hash of its own for each copy of rows whose copies would fill half a bucket.

    There are at most twice as many such rows as buckets, a number and a flag each,
    so tasks may hold them; without any, the rows are left as they are. Their copies
    are counted per task, so a copy is moved once per task only.
    """
    many = hashed.groupBy("h").agg((F.count("*") * F.max("w")).alias("bytes"), F.count("*").alias("n"))
    hot = materialize(many.filter((F.col("n") > 1) & (F.col("bytes") > bucket_bytes // 2)).select("h", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return hashed
    marked = hashed.join(F.broadcast(hot), "h", "left")
    counted = marked.filter("hot").groupBy("h", F.xxhash64(F.lit(seed + 1), "record").alias("h2")).agg(
        F.first("record").alias("record"), F.first("w").alias("w"), F.count("*").alias("n")
    )
    copies = counted.select("record", "w", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"), "h", "h2").select(
        "record", F.xxhash64(F.lit(seed), "h", "h2", "copy").alias("h"), "w"
    )
    return marked.filter("hot IS NULL").select("record", "h", "w").unionByName(copies)


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 40) -> DataFrame:
    """``write_shards`` of documents into a fresh shared folder."""
    return write_shards(docs, work_dir(spark, "shards"), shards)
