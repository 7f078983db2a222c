"""Rows of arrays. The array is computed once: an inner explode makes the optimizer filter on its size first, which computes it again for each condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(df: DataFrame, keep: tuple[str | Column, ...], array: str, name: str, place: str = "_place") -> DataFrame:
    """``keep`` and a row for each element of an array, as ``name``; ``place`` numbers them from 0 if named."""
    out = df.select(*keep, F.posexplode_outer(F.expr(array)).alias(place, name)).where(F.col(place).isNotNull())
    return out.drop(place) if place == "_place" else out


def structs(df: DataFrame, keep: tuple[str | Column, ...], array: str, never_null: str) -> DataFrame:
    """``keep`` and the fields of each struct of an array; ``never_null`` is one of the fields."""
    return df.select(*keep, F.inline_outer(F.expr(array))).where(F.col(never_null).isNotNull())
