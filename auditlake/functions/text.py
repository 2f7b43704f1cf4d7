"""Word and substring expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FEW_WORDS = 64


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the (already lower-case) text holds one of the words."""
    if not words:
        return F.lit(False)
    if len(words) <= FEW_WORDS:
        # A plain OR chain is compiled; a lambda over an array is not.
        return reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words])
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: text.contains(w))


def hit_count(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the (already lower-case) text."""
    if not words:
        return F.lit(0)
    if len(words) <= FEW_WORDS:
        return reduce(lambda a, b: a + b, [text.contains(w.lower()).cast("int") for w in words])
    return F.size(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: text.contains(w)))
