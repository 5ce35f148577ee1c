"""Vector expressions, evaluated in the JVM and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for empty, unlike long or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def closeness(distance: Column) -> Column:
    """1 / (1 + distance), to six places."""
    return F.round(1 / (1 + distance), 6)


def is_zero(vector: Column) -> Column:
    """A provider's mark for a failed embedding."""
    return F.forall(vector, lambda x: x == 0)


def checked(vector: Column, dim: int) -> Column:
    """The vector; an error for one of another dimension."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit(f"dimension is not {dim}: "), F.size(vector).cast("string"))))
