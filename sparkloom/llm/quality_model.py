"""Quality classifier: ridge scores on random Fourier features of document statistics, calibrated isotonically.

Method: a text becomes a vector of statistics (lengths, character classes, repeats, stop-like words), scaled by robust
figures of a bounded sample. Random Fourier features cos(Wx + b) approximate a Gaussian kernel over them. Partition by
partition the features' normal equations are summed in two folds; the driver solves the ridge systems (of fixed size).
Labelled rows are scored by the fit of the fold they aren't in; these scores are pooled into a histogram, and isotonic
regression (pool adjacent violators) maps the scores of the fit of all rows to probabilities.

Scale: texts are read once; statistics (a few numbers a document) are kept in the checkpoint folder. Fitting moves one
matrix of (features + 1) ** 2 numbers per partition of labelled rows, merged in a tree of bounded groups.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, map_rows


@dataclass(frozen=True)
class Model:
    """features: of the kernel map. width: of the Gaussian kernel, in scaled units. ridge: penalty per labelled row.

    bins: of scores in calibration. weight_zero: weight of label 0 in the fit. prior: rows by which a bin is drawn to the
    overall share. threshold: score from which 1 is predicted. scale_rows: rows of the sample that scales statistics.
    """

    features: int = 256
    width: float = 12.0
    ridge: float = 3e-4
    bins: int = 512
    threshold: float = 0.3
    scale_rows: int = 4000
    seed: int = 11


STATS = 20
_DIGITS = bytes(range(0x30, 0x3A))
_LOWER, _UPPER = bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B))
_SPACE = b" \t\n\x0b\f\r"
_SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@/"
_STOPS = b".!?"
_LINE = re.compile(rb"[^\n]+")


def statistics(text: str | None) -> list[float]:
    """STATS figures of a whole text; all defined for null, empty and blank ones."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    count = lambda these: len(raw) - len(raw.translate(None, these))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, symbols, marks = count(_UPPER), count(_SYMBOLS), raw.count(b"!") + raw.count(b"?")
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    same = sum(a == b for a, b in zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    ends = raw.count(b".") + marks
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        np.log1p(100 * upper / n),
        np.log1p(100 * count(_DIGITS) / n),
        np.log1p(100 * symbols / n),
        np.log1p(100 * marks / w),
        np.log1p(100 * raw.count(b"|") / w),
        np.log1p(100 * (raw.count(b",") + raw.count(b";")) / w),
        np.log1p(ends / max(1, len(lines))),
        np.log1p(w / max(1, ends)),
        len(distinct) / w,
        len(pairs) / w,
        100.0 * same / w if same else 0.0,
        1.0 - len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))),
        np.log1p(100 * (len(raw) - len(text or "")) / n),
        len(distinct) / w**0.8,
        float(lengths.max()) if words else 0.0,
    ]


def with_statistics(df: DataFrame, text: str = "text", row: str = "doc_id") -> DataFrame:
    """(_row, _x) for every row of df."""
    kind = df.schema[row].dataType.simpleString()
    return map_rows(
        df, [F.col(row).alias("_row"), F.col(text).alias("_text")], f"_row {kind}, _x array<float>",
        lambda ids, texts: {"_row": ids, "_x": [[float(x) for x in statistics(t)] for t in texts]},
    )


class Fourier:
    """Random features of the scaled statistics, the same for a seed wherever they are made."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, m: Model):
        rng = np.random.default_rng(m.seed)
        self.center, self.scale = center, scale
        self.w = (rng.standard_normal((len(center), m.features)) / m.width).astype(np.float32)
        self.b = rng.uniform(0, 2 * np.pi, m.features).astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8).astype(np.float32)
        phi = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([phi, np.ones((len(z), 1), np.float32)])


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to y under weights, by pooling adjacent violators."""
    level: list[list[float]] = []
    for v, w in zip(y, weight):
        level.append([float(v), float(w), 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            b, a = level.pop(), level.pop()
            n = a[1] + b[1]
            level.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in level]) if level else np.zeros(0)


@dataclass
class Fitted:
    """A model ready to score statistics; constant where there was nothing to learn from."""

    fourier: Fourier | None
    beta: np.ndarray | None
    low: float
    high: float
    steps: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), float(self.steps[0]))
        raw = self.fourier(x) @ self.beta
        at = (raw - self.low) / max(self.high - self.low, 1e-9) * len(self.steps) - 0.5
        return np.interp(at, np.arange(len(self.steps)), self.steps)


def _matrix(columns) -> np.ndarray:
    return columns.flatten().to_numpy(zero_copy_only=False).reshape(len(columns), -1).astype(np.float64)


def _sums(rows: DataFrame, n: int, f) -> np.ndarray | None:
    """The sum over all rows of f(x, y), an array of n numbers. Each partition gives one, a second step adds up sixteen."""

    def part(batches):
        total = None
        for b in batches:
            if b.num_rows:
                made = f(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)).ravel()
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches):
        total = None
        for b in batches:
            for s in b.column(0).to_pylist():
                x = np.frombuffer(s)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = rows.mapInArrow(part, "s binary")
    parts = rows.rdd.getNumPartitions()
    while parts > 16:
        parts = -(-parts // 16)
        sums = sums.repartition(parts).mapInArrow(add, "s binary")
    found = [np.frombuffer(r[0]) for r in sums.collect()]
    assert all(len(x) == n for x in found)
    return np.sum(found, axis=0) if found else None


def fit(labelled: DataFrame, m: Model = Model()) -> Fitted:
    """Fit on rows (_x, _y): _y is 0 or 1. Without rows the score is 0.5; with one label only, that label's."""
    seen = labelled.agg(F.count("*"), F.avg("_y")).first()
    if not seen[0] or seen[1] in (0.0, 1.0):
        return Fitted(None, None, 0.0, 1.0, np.array([0.5 if not seen[0] else seen[1]]))
    share = min(1.0, 1.2 * m.scale_rows / seen[0])
    some = labelled.filter(F.pmod(F.xxhash64("_x"), F.lit(1_000_000)) < int(share * 1_000_000)).select("_x").limit(m.scale_rows)
    x = np.array([r[0] for r in some.collect()] or [r[0] for r in labelled.select("_x").limit(m.scale_rows).collect()])
    center = np.median(x, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(x - center), axis=0), np.maximum(0.25 * x.std(axis=0), 0.02))
    fourier = Fourier(center, scale, m)
    d = m.features + 1
    share = float(seen[1])

    def fold(x):
        """0 or 1, of a row's statistics, so that equal rows share a fold."""
        return np.ascontiguousarray(x, dtype=np.float32).view(np.uint32).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)

    def normal(x, y):
        phi, k = fourier(x).astype(np.float64), fold(x)[:, None]
        w = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))[:, None]  # both labels weigh alike
        return np.stack([np.hstack([phi.T @ (phi * w * (k == f)), phi.T @ (y[:, None] * w * (k == f))]) for f in (0, 1)])

    folds = _sums(labelled, 2 * d * (d + 1), normal).reshape(2, d, d + 1)
    penalty = m.ridge * seen[0] * np.eye(d)
    penalty[-1, -1] = 1e-9
    solve = lambda s, part: np.linalg.solve(s[:, :d] + part * penalty, s[:, d])
    beta, apart = solve(folds[0] + folds[1], 1.0), [solve(folds[1], 0.5), solve(folds[0], 0.5)]

    def histogram(x, y):
        phi = fourier(x)
        raw = np.clip(np.where(fold(x) == 0, phi @ apart[0], phi @ apart[1]), -0.5, 1.5 - 1e-9)
        at = ((raw + 0.5) / 2 * m.bins).astype(int)
        return np.stack([np.bincount(at, minlength=m.bins), np.bincount(at, weights=y, minlength=m.bins)])

    count, ones = _sums(labelled, 2 * m.bins, histogram).reshape(2, m.bins)
    full = np.flatnonzero(count)
    steps = np.interp(np.arange(m.bins), full, isotonic(ones[full] / count[full], count[full]))
    return Fitted(fourier, beta, -0.5, 1.5, np.clip(steps, 0.0, 1.0))


def classify(docs: DataFrame, labels: DataFrame, m: Model = Model(), text: str = "text", row: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per row of docs: row, held_out, score, predicted.

    Labels teach only where crc32 of the row id as text, modulo 5, is not 0; those rows are held out, and null ids count
    as held out. Null labels teach nothing. Null, empty and blank texts are scored like others, from their statistics.
    Repeated rows are each returned, and teach as often as they are labelled. Empty tables give empty results; without
    labels every score is 0.5. Other columns of docs are not read.
    """
    made = cut(with_statistics(docs, text, row).withColumn("_held", F.coalesce(crc_mod(F.col("_row"), 5) == 0, F.lit(True))))
    truth = labels.select(F.col(row).alias("_row"), F.when(F.col(label) > 0, 1.0).when(F.col(label) <= 0, 0.0).alias("_y")).filter("_y is not null")
    labelled = cut(made.filter(~F.col("_held")).join(truth, "_row").select("_x", "_y"))
    fitted = docs.sparkSession.sparkContext.broadcast(fit(labelled, m))
    kind = docs.schema[row].dataType.simpleString()
    at = m.threshold

    def run(ids, held, xs):
        score = fitted.value.score(np.array(xs, dtype=np.float64)) if xs else np.zeros(0)
        score = np.clip(np.round(score, 9), 0, 1)
        return {"_row": ids, "held_out": held, "score": score.tolist(), "predicted": (score >= at).astype(int).tolist()}

    return map_rows(made, ["_row", "_held", "_x"], f"_row {kind}, held_out boolean, score double, predicted int", run).withColumnRenamed("_row", row)
