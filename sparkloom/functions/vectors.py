"""Column expressions on ARRAY<FLOAT> vectors, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "manhattan")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v over its length, or over eps where it is shorter than that."""
    scaled = F.transform(F.array(F.greatest(norm(v), F.lit(eps))), lambda n: F.transform(doubles(v), lambda x: x / n))
    return F.element_at(scaled, 1)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """True euclidean, cosine (1 - similarity) or manhattan distance."""
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))
    if metric == "cosine":
        return 1.0 - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    if metric == "manhattan":
        return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))
    raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
