"""Threshold alerts over a drift metrics table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``condition`` is a SQL predicate over the drift table; ``metric`` the
    column whose value is reported with a fired alert."""

    name: str
    metric: str
    condition: str


# Fixed value: the example rule of the source material.
DEFAULT_RULES = (Rule("wasserstein_over_0_05", "wasserstein_distance", "wasserstein_distance > 0.05"),)


def alerts(drift: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, keys: Sequence[str] | None = None) -> DataFrame:
    """``(rule, keys..., metric_value)`` for every (row, rule) whose condition holds.

    All rules are evaluated in one pass over the drift table.
    """
    keys = list(keys) if keys is not None else [c for c in ("window_start", "baseline_start", "slice", "column_name") if c in drift.columns]
    checks = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.col(r.metric).cast("double").alias("metric_value"),
                F.coalesce(F.expr(r.condition), F.lit(False)).alias("_fired"),
            )
            for r in rules
        ]
    )
    fired = drift.select(*keys, F.inline(F.filter(checks, lambda c: c["_fired"])))
    return fired.select("rule", *keys, "metric_value")
