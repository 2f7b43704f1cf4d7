"""Named queries over the standard tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL, by key."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.unrounded: set[str] = set()

    def add(self, key: str, sql: str | None = None, rounded: bool = True) -> Callable[[Query], Query]:
        """``rounded=False``: the query rounds by itself, to more digits than others."""

        def keep(fn: Query) -> Query:
            self.queries[key] = fn
            if not rounded:
                self.unrounded.add(key)
            if sql is not None:
                self.sql[key] = sql.strip()
            return fn

        return keep


def shown(value: Column) -> Column:
    """A double as it is compared with SQL: six decimals."""
    return F.round(value, 6)


def _shown(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        kinds = dict(df.dtypes)
        return df.select(*[shown(F.col(f"`{c}`")).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in df.columns])

    return run


def registry() -> Registry:
    """All families in order. Operators do not round; the queries do, and so does their SQL."""
    from auditlake.plans import (
        access,
        charts,
        findings,
        fingerprints,
        fraud,
        profiles,
        relations,
        retrieval,
        shapes,
        streams,
        usage,
    )

    merged = Registry()
    for family in (
        access, shapes, profiles, fraud, findings, relations, fingerprints, retrieval, usage, charts, streams
    ):
        merged.queries.update({k: fn if k in family.REG.unrounded else _shown(fn) for k, fn in family.REG.queries.items()})
        merged.sql.update(family.REG.sql)
    return merged
