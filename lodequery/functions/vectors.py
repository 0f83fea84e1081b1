"""Vector arithmetic on array columns; sums run in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(v: Column) -> Column:
    """The vector over its length; null for the zero vector."""
    scaled = lambda u: let(norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x.cast("double") / n)))
    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b, normalised: early fusion of two signals."""
    return normalize(F.zip_with(a, b, lambda x, y: F.lit(alpha) * x.cast("double") + F.lit(1.0 - alpha) * y.cast("double")))


def pair_features(q: Column, c: Column) -> Column:
    """Products, absolute differences and the dot product, one after the other: 2 * d + 1 values."""
    product = F.zip_with(q, c, lambda x, y: x.cast("double") * y.cast("double"))
    gap = F.zip_with(q, c, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.concat(product, gap, F.array(dot(q, c)))


def well_formed(v: Column, dimension: int | None = None) -> Column:
    """Neither null nor empty, finite, and not the zero vector; of that dimension if one is given."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = v.isNotNull() & (F.size(v) > 0) & finite & (norm(v) > 0)
    return ok if dimension is None else ok & (F.size(v) == dimension)
