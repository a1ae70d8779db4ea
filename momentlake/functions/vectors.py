"""Vector expressions; arithmetic is in double, whatever the element type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-12


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v divided by its norm; by 1 where the norm is at most 1e-12."""
    n = norm(v)
    both = F.array(F.struct(_double(v).alias("v"), F.when(n > GUARD, n).otherwise(1.0).alias("n")))  # the norm once a vector, not once a component
    return F.transform(both, lambda b: F.transform(b["v"], lambda x: x / b["n"]))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either norm is at most 1e-12."""
    na, nb = norm(a), norm(b)
    return F.when((na > GUARD) & (nb > GUARD), dot(a, b) / (na * nb)).otherwise(0.0)


def is_valid(v: Column, dimension: Column | int | None = None) -> Column:
    """Non-empty, finite in every component, of the dimension where one is given; null is invalid."""
    bad = F.exists(_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = (F.size(v) > 0) & ~bad
    return F.coalesce(ok if dimension is None else ok & (F.size(v) == dimension), F.lit(False))


def component_mean(v: Column, dimension: int) -> Column:
    """Aggregate: the mean of each component, as an array; map-side combined, one row a group."""
    return F.array(*(F.avg(_double(v)[k]) for k in range(dimension)))
