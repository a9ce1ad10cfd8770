"""Samples of an exact size that don't depend on partitioning.

Each row gets a number from its key columns and a seed (the first 15 hex digits
of an md5, so other engines can draw the same rows); the ``n`` rows with the
smallest numbers are the sample.  The n-th smallest number is found as an order
statistic over one stored column, and one pass over the table takes the rows
below it: nothing is sorted but the rows that tie with it, which are taken in
the order of all their columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.lineage import stored
from ratelens.operators.ranking import order_statistics


def sample_number(key_cols: Sequence[str], seed: int) -> Column:
    """0 to 16**15 - 1, from the md5 of the seed and ``|=value`` (null: ``|-``) of each key column."""
    parts = [F.coalesce(F.concat(F.lit("|="), F.col(c).cast("string")), F.lit("|-")) for c in key_cols]
    return F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def exact_sample(df: DataFrame, key_cols: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of ``df`` (all rows if it has no more), the same ones on every run and partitioning.

    Null keys count as values; repeated rows are drawn one by one, equal ones
    in any order; an empty table or ``n = 0`` gives no rows.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df.limit(0)
    number = sample_number(key_cols, seed)
    column = stored(df.select(number.alias("number")))
    total = column.count()
    if n >= total:
        return df
    last = order_statistics(column, "number", total, [n - 1])[n - 1]
    below = column.where(F.col("number") < last).count()
    ties = df.where(number == last).orderBy(*df.columns).limit(n - below)
    return df.where(number < last).unionAll(ties)
