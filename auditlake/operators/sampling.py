"""Deterministic samples of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """First n rows by a unique key."""
    return df.orderBy(order_by).limit(n)


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample(
    df: DataFrame,
    n: int,
    strategy: str,
    key: str,
    ts: str | None = None,
    stratum: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """n rows: the newest, a seeded random draw, or spread over the strata in turn."""
    if strategy == "recent":
        return df.orderBy(F.col(ts).desc(), F.col(key)).limit(n)
    if strategy == "random":
        return df.orderBy(_draw(key, seed), F.col(key)).limit(n)
    if strategy == "diverse":
        # The filter lets every task keep n rows per stratum before the shuffle.
        turn = F.row_number().over(Window.partitionBy(stratum).orderBy(_draw(key, seed), F.col(key)))
        picked = df.withColumn("_turn", turn).filter(F.col("_turn") <= n)
        return picked.orderBy("_turn", F.col(stratum), F.col(key)).limit(n).drop("_turn")
    raise ValueError(f"unknown sampling strategy: {strategy}")
