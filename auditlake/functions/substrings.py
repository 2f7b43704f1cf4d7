"""Which of many names occur in which texts: one automaton over all names.

The names become one multi-pattern automaton that a task runs once over each of
its texts, so neither texts nor substrings are shuffled and the work does not
depend on how common a name is. A set of names whose automaton would be too large
is cut by hash into several, and the texts are read once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.session import materialize

#: Characters of names in one automaton: about 50 bytes a character in a task, so some 100 MB at most.
MOST_CHARACTERS = 2_000_000


def _automata(needles: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The (label, pattern) rows, cut into sets of about ``most`` characters, each in order of its labels."""
    total = needles.agg(F.coalesce(F.sum(F.length("pattern") + 1), F.lit(0))).first()[0]
    cuts = max(1, -(-int(total) // most))
    if cuts == 1:
        yield sorted(map(tuple, needles.collect()), key=lambda r: r[0])
        return
    needles = materialize(needles)
    part = F.pmod(F.xxhash64("pattern"), F.lit(cuts))
    for i in range(cuts):
        # One cut at a time reaches the driver; its size is bounded by ``most``.
        yield sorted(map(tuple, needles.filter(part == i).collect()), key=lambda r: r[0])


def _scan(names: list[tuple[str, str]], spark, schema: StructType, n: int | None):
    shared = spark.sparkContext.broadcast(names)

    def scan(batches):
        import ahocorasick
        import pyarrow as pa

        labels = [label for label, _ in shared.value]
        spelled: dict[str, list[int]] = {}
        for i, (_, pattern) in enumerate(shared.value):
            spelled.setdefault(pattern, []).append(i)
        machine = ahocorasick.Automaton()
        for pattern, places in spelled.items():
            machine.add_word(pattern, tuple(places))
        machine.make_automaton()
        single = all(len(p) == 1 for p in spelled.values())
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not text:
                    continue
                hits = {p for _, p in machine.iter(text)}
                if not hits:
                    continue
                # Labels are numbered in their order, so the first ones are the smallest numbers.
                numbers = sorted(p[0] for p in hits) if single else sorted({x for p in hits for x in p})
                numbers = numbers[:n]
                rows += [i] * len(numbers)
                found += [labels[x] for x in numbers]
            at = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(at) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=schema.names)

    return scan


def occurrences(
    hay: DataFrame, keep: list[str], text: str, needles: DataFrame, label: str, pattern: str, n: int | None = None,
    most: int = MOST_CHARACTERS,
) -> DataFrame:
    """(the columns ``keep`` of ``hay``, label) where the pattern of a needle occurs in the text of a row.

    Each label once per row, whatever its number of places. With ``n`` only the
    ``n`` smallest labels of a row are listed, per cut of the needles. Null and
    empty texts and patterns match nothing. Patterns and texts are compared as
    they are: lower both for a match that ignores case. Needles with one label are
    expected once. Labels are texts.
    """
    names = needles.select(F.col(label).alias("label"), F.col(pattern).alias("pattern")).filter(F.length("pattern") > 0)
    rows = hay.select(*keep, F.col(text).alias("_hay"))
    schema = StructType([*(rows.schema[c] for c in keep)]).add(label, "string")
    parts = []
    for cut in _automata(names, most):
        if cut:
            parts.append(rows.mapInArrow(_scan(cut, hay.sparkSession, schema, n), schema))
    if not parts:
        return rows.filter(F.lit(False)).select(*keep, F.lit(None).cast("string").alias(label))
    return reduce(DataFrame.unionByName, parts)
