"""Dense vectors held as ARRAY<FLOAT> or ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def repair_zero(vector: Column) -> Column:
    """An all-zero vector gets 1 as its first element, so that cosine is defined."""
    has_value = F.exists(vector, lambda x: x != 0)
    fixed_up = F.transform(vector, lambda x, i: F.when(i == 0, F.lit(1.0)).otherwise(x).cast("float"))
    return F.when(has_value, vector).otherwise(fixed_up)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when one side has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)
