"""Exploding arrays that are costly to compute.

A plain ``explode`` makes Spark filter on the array's size first, which computes the array again
in the filter, below whatever join or exchange comes in between. The outer form has no such
filter; dropping its NULL row gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_values(df: DataFrame, keep: list, values: Column, name: str) -> DataFrame:
    """One row per element; elements must not be NULL."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def explode_positions(df: DataFrame, keep: list, values: Column, at: str, name: str) -> DataFrame:
    """One row per element with its 0-based position."""
    return df.select(*keep, F.posexplode_outer(values).alias(at, name)).where(F.col(at).isNotNull())
