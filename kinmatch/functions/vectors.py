"""Vector arithmetic on array columns, computed in double precision.

These expressions stay inside the JVM and suit a few vectors per row.  Scoring
a whole corpus against a query set goes through ``operators.similarity``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.bind import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def is_finite(v: Column) -> Column:
    """Whether a vector is there, holds values, and all of them are finite numbers."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Scale to unit length; a zero vector is left as it is."""
    divisor = F.when(l2_norm(v) > 0, l2_norm(v)).otherwise(F.lit(1.0))
    return let(divisor, lambda d: F.transform(v, lambda x: x.cast("double") / d))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0.0 for null, empty, zero or unequally long vectors, and for any that is not finite."""
    norms = l2_norm(a) * l2_norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0) & (norms < float("inf"))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))
    return F.coalesce(F.when(usable, value), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; null for unequally long vectors."""
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.transform(diffs, lambda d: d * d))))


def blend(base: Column, noise: Column, share: Column | float) -> Column:
    """Unit vector of ``share * base + (1 - share) * noise``."""
    share = F.lit(share) if not isinstance(share, Column) else share
    mixed = F.zip_with(base, noise, lambda x, y: share * x.cast("double") + (1 - share) * y.cast("double"))
    return normalise(mixed)


def distance_to_similarity(distance: Column) -> Column:
    """Cosine of two unit vectors from their distance, never below zero."""
    return F.greatest(F.lit(0.0), 1 - distance * distance / 2)
