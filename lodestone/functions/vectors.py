"""Vector arithmetic on array columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def valid(v: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and finite components only."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def rank_share(rank: Column, weight: float = 1.0, offset: int = 60) -> Column:
    """What a place in a ranked list adds to a fused score."""
    return F.lit(weight) / (F.lit(offset) + rank)
