"""Vector algebra as column expressions; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, floor: float | None = None) -> Column:
    """Unit vector. A zero vector stays zero; with ``floor`` the divisor is at least that."""
    n = l2_norm(v)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n) if floor is None else F.greatest(n, F.lit(floor))
    return F.transform(_doubles(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine in [-1, 1]; 0 if a vector has no length."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def knn_score(a: Column, b: Column) -> Column:
    """Search score in [0, 1]: (1 + cosine) / 2. Not the same scale as :func:`cosine`."""
    return (1 + cosine(a, b)) / 2


def centroid_distance(a: Column, b: Column) -> Column:
    """1 - inner product, in [0, 2] for unit vectors."""
    return 1 - dot(a, b)
