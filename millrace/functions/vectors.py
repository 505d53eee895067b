"""Vector expressions over array columns: no Python on rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 256  # dimensions up to which a literal vector becomes plain arithmetic, which Spark compiles


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot_literal(a: Column, q: Sequence[float]) -> Column:
    """Dot product with a fixed vector."""
    if len(q) > UNROLL:
        return dot(a, F.array(*(F.lit(float(x)) for x in q)))
    return reduce(lambda s, ix: s + F.get(a, F.lit(ix[0])).cast("double") * F.lit(float(ix[1])), enumerate(q), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _distance(product: Column, norms: Column) -> Column:
    return F.when(norms > 0, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(product, norms)))).otherwise(1.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, clamped; 1 where a vector is zero."""
    return _distance(dot(a, b), norm(a) * norm(b))


def cosine_distance_literal(a: Column, q: Sequence[float]) -> Column:
    length = sum(float(x) ** 2 for x in q) ** 0.5
    return _distance(dot_literal(a, q), norm(a) * F.lit(length))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def normalised(a: Column) -> Column:
    """a over its length; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x on [0, 1]; 0.5 where all values are equal."""
    return F.when(high > low, F.try_divide(x - low, high - low)).otherwise(0.5)


def capped_ratio(num: Column, den: Column, tiny: float = 1e-9) -> Column:
    """num / den, at most 1; null where den is (almost) zero."""
    return F.when(den > tiny, F.least(F.lit(1.0), F.try_divide(num, den)))
