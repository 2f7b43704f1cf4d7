"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Each text becomes some twenty statistics. A fixed random cosine map approximates
a Gaussian kernel over them. Every task sums the normal equations of its rows;
the sums are added and solved once, and the raw scores are calibrated by
isotonic regression on rows of the sample that the fit did not see.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import batches, byte_texts, labelled_sample

#: The fit sees about this many labelled rows at most; a quarter of them calibrates.
SAMPLE = 40_000
#: Tasks that sum the normal equations of the sample, and so partial sums that are added.
PARTS = 12
MIN_WORDS = 1
#: Byte classes: symbols, exclamation marks, capitals, small letters, digits, line ends, other marks, upper bytes.
_CLASSES = ["#*$%&|<>", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", "\"'(),-./:;=?@[]^_`{}~+\\"]
_CLASS = np.full(256, len(_CLASSES) + 1, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = len(_CLASSES)
N_FEATURES = 19


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; all zero when it has no word."""
    words = text.split()
    n = len(words)
    if n < MIN_WORDS:
        return [0.0] * N_FEATURES
    marks = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 2)
    symbols, bangs, upper, lower, digits, ends, other, high, _ = (int(x) for x in marks)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    share = np.fromiter(counts.values(), float, len(counts)) / n
    keys = np.fromiter(map(hash, words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeats = int((keys[1:] == keys[:-1]).sum())
    pairs = keys[:-1] * np.int64(1_000_003) + keys[1:]
    letters = max(1, upper + lower)
    size = len(text)
    return [
        np.log1p(size), np.log1p(n), float(lengths.mean()), float(np.log1p(lengths.std())), float(np.log1p(lengths.max())),
        symbols / n, bangs / n, upper / letters, digits / size, other / size, high / size, ends / n,
        float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),
        repeats / n, len(counts) / n, float(share.max()), float(-(share * np.log(share)).sum()),
        1 - len(np.unique(pairs)) / max(1, len(pairs)) if n > 1 else 0.0,
    ]


@dataclass
class KernelRidge:
    """Everything a task needs to score texts; a few hundred kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.waves + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns knots for linear interpolation. Ties share one value."""
    points, where = np.unique(raw, return_inverse=True)
    total, weight = np.bincount(where, y), np.bincount(where).astype(float)
    blocks: list[list[float]] = []
    for i in range(len(points)):
        blocks.append([total[i], weight[i], points[i], points[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, _, hi = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
            blocks[-1][3] = hi
    xs, ys = [], []
    for t, w, lo, hi in blocks:
        for x in dict.fromkeys((lo, hi)):
            xs.append(x)
            ys.append(t / w)
    return np.array(xs), np.array(ys)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    waves: int = 256, ridge: float = 1e-3, sample: int = SAMPLE, seed: int = 17,
) -> KernelRidge:
    """Fit on about ``sample`` labelled rows. Without usable rows every text scores one half."""
    rng = np.random.default_rng(seed)

    def features(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            x = [statistics(t) for t in byte_texts(batch.column(0))]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": batch.column(1), "part": batch.column(2)})

    rows = labelled_sample(docs, labels, label, doc_id, text, sample, seed)
    rows = rows.mapInArrow(features, "x array<double>, y int, part int").repartition(PARTS).checkpoint()
    moments = rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"))
    found = {r["pos"]: (r["m"], r["s"]) for r in moments.collect()}
    mean = np.array([found.get(i, (0.0, 1.0))[0] for i in range(N_FEATURES)])
    scale = np.array([found.get(i, (0.0, 1.0))[1] or 1.0 for i in range(N_FEATURES)])
    model = KernelRidge(
        mean, scale, rng.normal(0, 1 / np.sqrt(N_FEATURES / 2), (N_FEATURES, waves)), rng.uniform(0, 2 * np.pi, waves)
    )
    size = waves + 1

    def normal_equations(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches(iterator, 4096):
            z = model.lift(np.array(batch.column(0).to_pylist()))
            left += z.T @ z
            right += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
            n += len(z)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.append(left.ravel(), right)], pa.list_(pa.float64())), "n": [n]})

    parts = rows.filter("part > 0").select("x", "y").mapInArrow(normal_equations, "sums array<double>, n long").collect()
    total = sum((np.array(r["sums"]) for r in parts), np.zeros(size * size + size))
    left, right = total[: size * size].reshape(size, size), total[size * size :]
    n = sum(r["n"] for r in parts)
    if not n:
        model.weights, model.steps = np.zeros(size), (np.zeros(1), np.full(1, 0.5))
        return model
    model.weights = np.linalg.solve(left + ridge * n * np.diag([1.0 / size] * waves + [1e-9]), right)

    def raw(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 4096):
            yield pa.RecordBatch.from_pydict({"raw": model.raw(np.array(batch.column(0).to_pylist())), "y": batch.column(1)})

    seen = rows.filter("part = 0").select("x", "y").mapInArrow(raw, "raw double, y int").collect()
    if not seen:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    else:
        model.steps = isotonic(np.array([r["raw"] for r in seen]), np.array([r["y"] for r in seen], float))
    return model


def score(docs: DataFrame, model: KernelRidge, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score) per document, or with ``keep`` all columns of ``docs`` and, last, ``_score``.

    A column of that name in ``docs`` keeps it; the score then gets another
    underscore. Whole texts are read. A null text counts as empty; texts without a word share
    one score. Repeated rows give repeated results, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if keep else docs.select(F.col(doc_id), F.col(text).alias("_text"))
    at = rows.columns.index(text) if keep else 1
    wanted = list(range(len(rows.columns))) if keep else [0]
    name = "_score"
    while keep and name in rows.columns:
        name += "_"

    def scored(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            x = np.array([statistics(t) for t in byte_texts(batch.column(at))])
            names = [batch.schema.names[i] for i in wanted]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in wanted), pa.array(shared.value.score(x))], [*names, name])

    schema = StructType([rows.schema[i] for i in wanted]).add(name, "double")
    out = rows.mapInArrow(scored, schema)
    return out if keep else out.withColumnRenamed("_score", "score")
