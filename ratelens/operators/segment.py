"""Segment summary: ``groupBy(keys).agg(metrics)`` with ordering and top-k.

About 25 of the catalogue reports are one configuration of this operator.
Plan shape: scan (pruned to the used columns) -> partial hash aggregate ->
shuffle on the keys -> final aggregate -> (top-k: TakeOrderedAndProject, no
global sort).  A hot key costs nothing extra: the partial aggregate collapses
it to one row per map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.expr import money_avg, money_sum


def policy_triple(
    amount: str = "tot_wprm_amt",
    count_col: str = "rec_id",
    names: tuple[str, str, str] = ("policy_count", "total_premium", "avg_premium"),
    scale: int | None = None,
) -> list[Column]:
    """The standard count / total / average triple of most reports."""
    n, total, avg = names
    return [
        F.count(count_col).alias(n),
        money_sum(amount, scale).alias(total),
        money_avg(amount, scale).alias(avg),
    ]


def order_spec(order: Sequence[str | Column]) -> list[Column]:
    """Strings starting with '-' sort descending (nulls last); others ascending (nulls first)."""
    out = []
    for o in order:
        if isinstance(o, str):
            out.append(F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_first())
        else:
            out.append(o)
    return out


def segment_summary(
    df: DataFrame,
    keys: Sequence[str | Column],
    metrics: Sequence[Column],
    order: Sequence[str | Column] = (),
    top: int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Aggregate ``metrics`` per ``keys``; optionally sort and keep the top rows.

    With ``top`` set, the group keys are appended to the sort as a tie-break,
    so the rows kept at the cut are the same on every run.
    """
    src = df.where(where) if where is not None else df
    out = src.groupBy(*keys).agg(*metrics)
    if not order and top is None:
        return out
    spec = order_spec(order)
    if top is not None:
        key_names = [k if isinstance(k, str) else None for k in keys]
        tie = [F.col(k).asc_nulls_first() for k in key_names if k is not None]
        return out.orderBy(*spec, *tie).limit(top)
    return out.orderBy(*spec)
