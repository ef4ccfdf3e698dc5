"""Cosine similarity and the scales derived from it, both ways, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALES = ("cosine", "jaccard", "cosine_norm", "jaccard_norm", "cosine-positive")


def from_cosine(s: Column, scale: str) -> Column:
    if scale == "cosine":
        return s
    if scale == "jaccard":
        return s / (2 - s)
    if scale == "cosine_norm":
        return (s + 1) / 2
    if scale == "jaccard_norm":
        return (3 * (s / (2 - s)) + 1) / 4
    if scale == "cosine-positive":
        return F.greatest(s, F.lit(0.0))
    raise ValueError(f"unknown scale {scale!r}; there are {SCALES}")


def to_cosine(x: Column, scale: str) -> Column:
    """The inverse; for cosine-positive, of what is not cut."""
    if scale == "cosine":
        return x
    if scale == "jaccard":
        return 2 * x / (1 + x)
    if scale == "cosine_norm":
        return 2 * x - 1
    if scale == "jaccard_norm":
        return to_cosine((4 * x - 1) / 3, "jaccard")
    if scale == "cosine-positive":
        return F.greatest(x, F.lit(0.0))
    raise ValueError(f"unknown scale {scale!r}; there are {SCALES}")


def cosine_from_squared_euclidean(d: Column) -> Column:
    """For unit vectors."""
    return 1 - d / 2


def euclidean_from_cosine(similarity: float) -> float:
    """Distance of unit vectors with this cosine: thresholds of Birch and DBSCAN."""
    if not -1 <= similarity <= 1:
        raise ValueError("a cosine lies in [-1, 1]")
    return (2 * (1 - similarity)) ** 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def squared_euclidean(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))
