"""Similarity of two columns, as a number from -100 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine100(a: Column, b: Column) -> Column:
    """Cosine of two vectors times 100. An all-zero vector gives 0; a null one gives null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms * 100)


def unit_dot100(a: Column, b: Column) -> Column:
    """:func:`cosine100` for vectors already of length 1; 0 where one is missing."""
    return F.coalesce(dot(a, b) * 100, F.lit(0.0))


def set_cosine100(a: Column, b: Column) -> Column:
    """:func:`cosine100` of two lists of distinct words seen as 0/1 vectors."""
    sizes = F.cardinality(a).cast("double") * F.cardinality(b).cast("double")
    shared = F.cardinality(F.array_intersect(a, b)).cast("double")
    return F.when(sizes > 0, shared / F.sqrt(sizes) * 100).otherwise(F.lit(0.0))
