"""Pivots: one row per key, one column per value of a second column.

Without explicit values Spark first runs a distinct job to learn the column
set (capped by ``spark.sql.pivotMaxValues``); passing ``values`` skips that
job and fixes the output schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fill_zero(df: DataFrame, key: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    return df.fillna(0, subset=cols) if cols else df


def pivot_count(
    df: DataFrame, key: str, pivot_col: str, count_col: str, values: Sequence[str] | None = None
) -> DataFrame:
    """``count(count_col)`` per (key, pivot value), missing cells 0."""
    g = df.groupBy(key)
    p = g.pivot(pivot_col, list(values)) if values is not None else g.pivot(pivot_col)
    return _fill_zero(p.agg(F.count(count_col)), key)


def pivot_sum(
    df: DataFrame, key: str, pivot_col: str, sum_col: str, values: Sequence[str] | None = None
) -> DataFrame:
    """``sum(sum_col)`` per (key, pivot value), missing cells 0."""
    g = df.groupBy(key)
    p = g.pivot(pivot_col, list(values)) if values is not None else g.pivot(pivot_col)
    return _fill_zero(p.sum(sum_col), key)
