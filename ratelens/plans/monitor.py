"""Month-over-month drift monitors for the three load layouts.

* time series: one table with a timestamp column; each calendar window is
  compared with the previous one (``drift_time_series``)
* snapshot: a current table (or slice) against a baseline table
  (``drift_snapshot``; the truncate-and-overwrite layout uses a baseline
  captured in a ``SnapshotStore`` before the overwrite)
* separate tables: one table per month, every month against its predecessor
  (``drift_separate``)

All three end in the same plan: long value counts -> counts dealt by value
range and paired -> metrics per ``(window_start, baseline_start, slice, column_name)``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import categorical_columns, numeric_columns, temporal_columns
from ratelens.functions.lineage import stored
from ratelens.operators.alerts import DEFAULT_RULES, Rule, alerts
from ratelens.operators.drift_metrics import DRIFT_COLUMNS, categorical_drift, numeric_drift
from ratelens.operators.profile import Layout, long_value_counts, profile_from_counts, slice_column

DRIFT_KEYS = ["window_start", "baseline_start", "slice", "column_name"]
_UNITS = {"day", "week", "month", "quarter", "year"}
_RESERVED = {"year", "month", "load_date"}


def window_unit(window: str) -> str:
    """``'1 month'`` / ``'month'`` / ``'1 MONTH'`` -> ``'month'``."""
    parts = window.strip().lower().split()
    if len(parts) == 2 and parts[0] == "1":
        parts = parts[1:]
    unit = parts[0].rstrip("s") if len(parts) == 1 else ""
    if unit not in _UNITS:
        raise ValueError(f"unsupported window {window!r}; use 1 day/week/month/quarter/year")
    return unit


def window_start(ts: str | Column, unit: str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    day = c.cast("timestamp").cast("date")
    return day if unit == "day" else F.trunc(day, unit)


def shift_window(d: Column, unit: str, k: int = 1) -> Column:
    if unit in ("month", "quarter", "year"):
        return F.add_months(d, k * {"month": 1, "quarter": 3, "year": 12}[unit])
    return F.date_add(d, k * (7 if unit == "week" else 1))


def split_columns(df: DataFrame, columns: Sequence[str] | None, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical monitored columns; dates and timestamps count as numbers (days since 1970).

    When ``columns`` is None: all numeric, date, timestamp, string and boolean
    ones but the load columns ``year``, ``month`` and ``load_date``.  Asked
    columns are monitored whatever their name; one of another type (binary,
    nested) raises a ValueError.
    """
    def of(skip: set) -> tuple[list[str], list[str]]:
        kinds = {*numeric_columns(df, skip), *temporal_columns(df, skip)}
        return [c for c in df.columns if c in kinds], categorical_columns(df, skip)

    if columns is None:
        return of(set(exclude) | _RESERVED)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"monitored column(s) {missing} not in table")
    num, cat = of(set())
    other = [c for c in columns if c not in num and c not in cat]
    if other:
        raise ValueError(f"monitored column(s) {other} are neither numbers, dates, strings nor booleans")
    return [c for c in columns if c in num], [c for c in columns if c in cat]


def critical_view(df: DataFrame, columns: Sequence[str], ts_col: str | None = None, name: str | None = None) -> DataFrame:
    """The critical columns (plus the timestamp) of a wide table; registered as
    a temp view when ``name`` is given.  Selecting first means only these
    Parquet columns are read by any monitor built on the view."""
    out = df.select(*columns, *([ts_col] if ts_col else []))
    if name:
        out.createOrReplaceTempView(name)
    return out


def hash_sample(df: DataFrame, key_cols: Sequence[str], fraction: float) -> DataFrame:
    """Deterministic row sample: the same rows on every run and partitioning."""
    scale = 1_000_000
    h = F.pmod(F.xxhash64(*[F.col(c) for c in key_cols]), F.lit(scale))
    return df.where(h < F.lit(int(round(fraction * scale))))


def _metrics(
    vc: DataFrame,
    layout: Layout,
    pair: Callable[[DataFrame], DataFrame],
    baseline_start: Callable[[Column], Column],
    buckets: int | None,
    mean_scale: int | None,
    group_cols: Sequence[str] = (),
    sample: Sequence[str] = (),
) -> DataFrame:
    """Drift metrics from the stored counts ``(_g, [_groups], [sample columns], col_id, num, cat, n)`` of every sample.

    ``pair`` gives a sample's rows to the comparisons it takes part in (see ``numeric_drift``).
    """
    groups = list(group_cols)
    keys = ["_g", "_groups"] if groups else ["_g"]
    of_sample = [*keys, *sample]
    is_num = F.col("col_id") < len(layout.numeric)
    parts = []
    if layout.numeric:
        num = vc.where(is_num).select(*of_sample, layout.series("_g"), F.col("num").alias("value"), "n")
        parts.append(numeric_drift(num, keys, of_sample, pair, buckets, mean_scale))
    if layout.categorical:
        cat = pair(vc.where(~is_num).select(*of_sample, F.col("cat").alias("value"), "n")).groupBy(*keys, "value").agg(
            F.sum(F.when(F.col("_is_b"), F.col("n")).otherwise(0)).alias("n_b"),
            F.sum(F.when(F.col("_is_b"), 0).otherwise(F.col("n"))).alias("n_c"),
        )
        parts.append(categorical_drift(cat, keys))
    out = functools.reduce(DataFrame.unionByName, parts)
    names = layout.decode()
    ws = names["window_start"]
    return out.select(
        ws.alias("window_start"),
        baseline_start(ws).alias("baseline_start"),
        names["slice"].alias("slice"),
        *[F.col("_groups").getField(c).alias(c) for c in groups],
        names["column_name"].alias("column_name"),
        *DRIFT_COLUMNS,
    )


def _drift_from_window_counts(
    vc: DataFrame,
    layout: Layout,
    unit: str,
    buckets: int | None,
    mean_scale: int | None = None,
    group_cols: Sequence[str] = (),
    listed: Sequence[Column] | None = None,
) -> DataFrame:
    """Pair every window's counts with the previous window's.

    The counts (one row per window, slice, column and distinct value) are
    stored once; a window's rows are current in its own comparison and
    baseline in the next one, which they join after the shuffle only.
    Metrics come for the ``listed`` windows, else for all up to the last one
    with rows and for rows without a window, which have no baseline.
    """
    vc = stored(vc)
    day = layout.day("_g")
    if listed is None:
        # baselines shifted past the last window are no windows
        last = vc.select(F.max(F.when(day != layout.NO_WINDOW, day))).first()[0]
        wanted = F.col("_day").isNull() | (F.col("_day") <= F.lit(last).cast("int"))
    else:
        wanted = F.col("_day").isin(*[F.unix_date(d) for d in listed])

    def pair(df: DataFrame) -> DataFrame:
        shifted = F.unix_date(shift_window(F.date_from_unix_date(day), unit))
        both = df.withColumn("_is_b", F.explode(F.array(F.lit(False), F.lit(True))))
        own = F.when(day != layout.NO_WINDOW, day)
        both = both.withColumn("_day", F.when(F.col("_is_b"), F.when(day != layout.NO_WINDOW, shifted)).otherwise(own))
        both = both.where(wanted & (~F.col("_is_b") | F.col("_day").isNotNull()))
        return both.withColumn("_g", layout.at_day("_g", F.col("_day"))).drop("_day")

    return _metrics(vc, layout, pair, lambda ws: shift_window(ws, unit, -1), buckets, mean_scale, group_cols)


def drift_time_series(
    df: DataFrame,
    ts_col: str,
    columns: Sequence[str] | None = None,
    slices: Sequence[str] | None = None,
    window: str = "1 month",
    buckets: int | None = None,
    mean_scale: int | None = None,
    group_cols: Sequence[str] = (),
    columns_per_pass: int | None = None,
) -> DataFrame:
    """Every window against the previous calendar window, one plan for all columns.

    A window whose predecessor has no rows gets ``status = 'NO_BASELINE'``
    and null metrics; a window, group, slice or column value set that is gone
    while its predecessor had rows gets ``status = 'NO_CURRENT'``.  Rows with a
    null timestamp are reported as a null window without a baseline, rows with
    a null group as a group of their own.  ``mean_scale``: exact decimal means for columns with
    at most that many decimals (None: double sums).  ``group_cols``: a
    granularity level; metrics per value of these columns (each group
    compared with the same group in the previous window).
    ``columns_per_pass``: monitor the columns in groups of this size, one
    scan each; the long frame of a pass is rows x group size instead of
    rows x all columns, which bounds the shuffle of very wide tables.
    """
    unit = window_unit(window)
    num, cat = split_columns(df, columns, [ts_col, *group_cols])
    if columns_per_pass and len(num) + len(cat) > columns_per_pass:
        cols = [*num, *cat]
        parts = [
            drift_time_series(df, ts_col, cols[i : i + columns_per_pass], slices, window, buckets, mean_scale, group_cols)
            for i in range(0, len(cols), columns_per_pass)
        ]
        return functools.reduce(DataFrame.unionByName, parts)
    layout = Layout(num, cat, slices)
    vc = long_value_counts(df, window_start(ts_col, unit), layout, group_cols)
    return _drift_from_window_counts(vc, layout, unit, buckets, mean_scale, group_cols)


def drift_snapshot(
    current: DataFrame,
    baseline: DataFrame,
    columns: Sequence[str] | None = None,
    slices: Sequence[str] | None = None,
    current_start: str | Column | None = None,
    baseline_start: str | Column | None = None,
    buckets: int | None = None,
    mean_scale: int | None = None,
) -> DataFrame:
    """Current table (or slice of it) against a baseline table.

    Slice predicates are evaluated on both tables, so each slice compares the
    same sub-population.  ``current_start`` / ``baseline_start`` label the
    result rows.
    """
    layout = Layout(*split_columns(current, columns), slices)
    cs = current_start if isinstance(current_start, Column) else F.lit(current_start).cast("date")
    bs = baseline_start if isinstance(baseline_start, Column) else F.lit(baseline_start).cast("date")
    sl = slice_column(layout.slices[1:]).alias("_slices")
    tagged = current.select(F.lit(0).alias("_b"), sl, *layout.columns).unionByName(
        baseline.select(F.lit(1).alias("_b"), sl, *layout.columns)
    )
    tagged = tagged.withColumn("_is_b", F.col("_b") == 1)
    # one comparison, whose window only labels the rows
    vc = stored(long_value_counts(tagged, F.lit(None).cast("date"), layout, sample=["_is_b"], slices_col="_slices", single_scan=True))
    out = _metrics(vc, layout, lambda df: df, lambda _: bs, buckets, mean_scale, sample=["_is_b"])
    return out.withColumn("window_start", cs)


def drift_separate(
    resolve: Callable[[int, int], DataFrame],
    months: Sequence[tuple[int, int]],
    columns: Sequence[str] | None = None,
    slices: Sequence[str] | None = None,
    buckets: int | None = None,
    mean_scale: int | None = None,
) -> DataFrame:
    """Separate table per month: each listed month against the month before.

    ``resolve(year, month)`` returns that month's table.  Each needed month
    is read once and tagged with its month; the pairing is the same single
    plan as the time-series monitor.  A listed month whose table is empty
    while its predecessor is not gives ``status = 'NO_CURRENT'``.
    """
    def prev(y: int, m: int) -> tuple[int, int]:
        return (y - 1, 12) if m == 1 else (y, m - 1)

    needed = sorted({*months, *[prev(*ym) for ym in months]})
    layout = Layout(*split_columns(resolve(*needed[0]), columns), slices)
    sl = slice_column(layout.slices[1:]).alias("_slices")
    tagged = None
    for y, m in needed:
        t = resolve(y, m).select(F.make_date(F.lit(y), F.lit(m), F.lit(1)).alias("_ws"), sl, *layout.columns)
        tagged = t if tagged is None else tagged.unionByName(t)
    vc = long_value_counts(tagged, F.col("_ws"), layout, slices_col="_slices", single_scan=True)
    listed = [F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y, m in sorted(set(months))]
    return _drift_from_window_counts(vc, layout, "month", buckets, mean_scale, listed=listed)


def profile(
    df: DataFrame,
    ts_col: str,
    columns: Sequence[str] | None = None,
    slices: Sequence[str] | None = None,
    window: str = "1 month",
    buckets: int | None = None,
    mean_scale: int | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Profile metrics per ``(window_start, slice, [group_cols], column_name)``."""
    unit = window_unit(window)
    layout = Layout(*split_columns(df, columns, [ts_col, *group_cols]), slices)
    vc = stored(long_value_counts(df, window_start(ts_col, unit), layout, group_cols))
    return profile_from_counts(vc, layout, "window_start", buckets, mean_scale, group_cols)


def custom_metrics(
    df: DataFrame,
    ts_col: str,
    metrics: Mapping[str, str],
    slices: Sequence[str] | None = None,
    window: str = "1 month",
) -> DataFrame:
    """User SQL aggregates per window and slice: ``(window_start, slice, metric_name, metric_value)``."""
    unit = window_unit(window)
    g = df.select("*", window_start(ts_col, unit).alias("window_start"), F.explode(slice_column(slices)).alias("slice"))
    names = F.array(*[F.lit(x) for x in ["all", *(slices or [])]])
    g = g.withColumn("slice", F.element_at(names, F.col("slice") + 1))
    wide = g.groupBy("window_start", "slice").agg(*[F.expr(sql).cast("double").alias(name) for name, sql in metrics.items()])
    return wide.unpivot(["window_start", "slice"], list(metrics), "metric_name", "metric_value")


def custom_metric_drift(
    df: DataFrame,
    ts_col: str,
    metrics: Mapping[str, str],
    slices: Sequence[str] | None = None,
    window: str = "1 month",
) -> DataFrame:
    """Each window's custom metric against the previous window's value."""
    unit = window_unit(window)
    cm = custom_metrics(df, ts_col, metrics, slices, window)
    prev = cm.select(
        shift_window(F.col("window_start"), unit).alias("window_start"), "slice", "metric_name", F.col("metric_value").alias("baseline_value")
    )
    return (
        cm.join(prev, ["window_start", "slice", "metric_name"], "left")
        .select(
            "window_start",
            shift_window(F.col("window_start"), unit, -1).alias("baseline_start"),
            "slice",
            "metric_name",
            "baseline_value",
            F.col("metric_value").alias("current_value"),
            (F.col("metric_value") - F.col("baseline_value")).alias("delta"),
        )
    )


def critical_vs_all(
    df: DataFrame,
    ts_col: str,
    critical: Sequence[str],
    rules: Sequence[Rule] = DEFAULT_RULES,
    window: str = "1 month",
    buckets: int | None = None,
    mean_scale: int | None = None,
) -> DataFrame:
    """Monitor every column once; per window, how many columns drifted among
    the critical ones and among all of them."""
    drift = drift_time_series(df, ts_col, None, None, window, buckets, mean_scale)
    flagged = alerts(drift, rules).select("window_start", "column_name").distinct().withColumn("_drifted", F.lit(1))
    crit = F.col("column_name").isin(list(critical))
    per_col = drift.where(F.col("slice") == "all").select("window_start", "column_name").join(
        flagged, ["window_start", "column_name"], "left"
    )
    return per_col.groupBy("window_start").agg(
        F.count(F.lit(1)).alias("columns_all"),
        F.sum(F.coalesce("_drifted", F.lit(0))).alias("drifted_all"),
        F.sum(F.when(crit, 1).otherwise(0)).alias("columns_critical"),
        F.sum(F.when(crit, F.coalesce("_drifted", F.lit(0))).otherwise(0)).alias("drifted_critical"),
    )
