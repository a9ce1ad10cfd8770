"""Column-expression builders shared by the reports.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: str | Column, scale: int | None = None) -> Column:
    """Sum of an amount column: the plain sum unless a ``scale`` is asked for.

    Floating-point sums depend in their last digits on the order rows meet in
    the aggregation buffers (i.e. on partitioning).  For columns known to carry
    at most ``scale`` decimals, and amounts below ``10**(18 - scale)``, a
    sum as ``decimal(18, scale)`` is exact and the same on every cluster
    layout.  Values with more decimals are rounded to ``scale`` then.
    """
    if scale is None:
        return F.sum(_c(c))
    return F.sum(_c(c).cast(T.DecimalType(18, scale))).cast("double")


def money_avg(c: str | Column, scale: int | None = None) -> Column:
    """Mean as ``money_sum / count`` (null when there is no non-null value)."""
    if scale is None:
        return F.avg(_c(c))
    return F.try_divide(money_sum(c, scale), F.count(_c(c)))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` when ``den > 0``, else null (also safe under ANSI mode)."""
    return F.when(_c(den) > 0, _c(num) / _c(den))


def any_true(predicates: Sequence[Column]) -> Column:
    """OR over a list of predicates (three-valued: ``null OR true`` is true)."""
    return functools.reduce(operator.or_, predicates)


def first_word(c: str | Column, sep: str = " ") -> Column:
    """First token of a string (``''`` stays ``''``, null stays null)."""
    return F.split(_c(c), sep).getItem(0)


def label_ladder(branches: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Chained ``CASE WHEN``: the first matching predicate gives the label."""
    (cond, label), *rest = branches
    out = F.when(cond, label)
    for cond, label in rest:
        out = out.when(cond, label)
    return out.otherwise(otherwise) if otherwise is not None else out


def null_inclusive_distinct(c: str | Column) -> Column:
    """Number of distinct values counting null as one value.

    Same number as ``df.select(c).distinct().count()`` (0 for no rows), but as one aggregate
    expression (so several can share one scan).
    """
    col = _c(c)
    return F.count_distinct(col) + F.coalesce(F.max(F.when(col.isNull(), 1).otherwise(0)), F.lit(0))
