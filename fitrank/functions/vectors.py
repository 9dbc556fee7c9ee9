"""Expressions over vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in -1..1; 0.0 if a vector is missing or has no length.

    Vectors of different sizes come from different models and are an error.
    """
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.coalesce(F.try_divide(dot(a, b), lengths), F.lit(0.0))
    sizes = F.concat_ws(" and ", F.size(a).cast("string"), F.size(b).cast("string"))
    other = F.raise_error(F.concat(F.lit("vectors of different sizes: "), sizes)).cast("double")
    return F.when(F.size(a) != F.size(b), other).otherwise(value)
