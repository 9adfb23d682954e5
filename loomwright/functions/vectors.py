"""Vectors as array columns; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_score(a: Column, b: Column) -> Column:
    """1 / (1 + d), d the squared distance."""
    return 1 / (1 + F.greatest(squared_l2(a, b), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 for (near) zero vectors and for vectors of different lengths."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > TINY), dot(a, b) / both).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > TINY, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def valid(a: Column, dim: int) -> Column:
    """Of the right length, without null, NaN or infinite components."""
    whole = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(a) == dim) & whole, F.lit(False))


def problem(a: Column, dim: int) -> Column:
    """Why a vector is rejected; null if it isn't."""
    return F.when(a.isNull(), "null").when(F.size(a) != dim, "wrong length").when(~valid(a, dim), "not finite")
