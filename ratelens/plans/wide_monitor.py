"""Drift over very wide tables, and incrementally: one month's rows are read once.

``drift_sketched`` compares every window of a table with the one before by
fixed-size sketches (see :mod:`ratelens.operators.sketch`).  ``SketchStore``
keeps each month's sketches as one partition of a Parquet table: a new month
reads its own rows only, and any two stored months are compared without
touching the monitored table again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions.lineage import stored
from ratelens.operators.profile import ALL_SLICE
from ratelens.operators.sketch import (
    CELL_COLUMNS,
    POINTS,
    SKETCH_DRIFT_COLUMNS,
    Grid,
    by_slice,
    cell_drift,
    column_stats,
    count_cells,
    learn_grid,
    merge_cells,
)
from ratelens.plans.monitor import shift_window, split_columns, window_start, window_unit


def make_grid(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), points: int = POINTS) -> Grid:
    """The grid of a baseline: its numeric, date and timestamp columns' quantiles, its other columns' cells."""
    num, cat = split_columns(df, columns, exclude)
    return learn_grid(df, num, cat, points)


def _named(out: DataFrame, grid: Grid, slices: Sequence[str] | None, *keys: Column) -> DataFrame:
    def name(values: Sequence[str], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)

    rest = [c for c in out.columns if c in (*SKETCH_DRIFT_COLUMNS, "row_count", "null_count", "mean", "stddev", "min_value", "max_value")]
    return out.select(
        *keys,
        name([ALL_SLICE, *(slices or [])], F.col("slice_id")).alias("slice"),
        *[F.col("groups").getField(c).alias(c) for c in _group_names(out)],
        name(grid.columns, F.col("col_id")).alias("column_name"),
        *rest,
    )


def _group_names(df: DataFrame) -> list[str]:
    return df.schema["groups"].dataType.names if "groups" in df.columns else []


def _paired(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of both sides in one row; a cell that a side lacks has count 0 and null values."""
    sides = []
    for frame, side in ((baseline, "b"), (current, "c")):
        sides.append(frame.select(*keys, "cell", F.lit(side).alias("_side"), *CELL_COLUMNS))
    both = sides[0].unionByName(sides[1]).groupBy(*keys, "cell")

    def of(c: str, side: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(c)))

    return both.agg(
        *[F.coalesce(of("n", s), F.lit(0)).alias(f"n_{s}") for s in "bc"],
        *[of(c, s).alias(f"{c}_{s}") for s in "bc" for c in CELL_COLUMNS[1:]],
    )


def drift_sketched(
    df: DataFrame,
    ts_col: str,
    grid: Grid | None = None,
    columns: Sequence[str] | None = None,
    slices: Sequence[str] | None = None,
    window: str = "1 month",
    group_cols: Sequence[str] = (),
    points: int = POINTS,
) -> DataFrame:
    """Every window against the previous one, by sketches; columns as ``drift_time_series``, and both error bounds.

    ``grid``: learned beforehand (``make_grid`` of a baseline month); None
    learns it from the whole table in one more scan.
    """
    unit = window_unit(window)
    grid = grid or make_grid(df, columns, [ts_col, *group_cols], points)
    groups = {"groups": F.struct(*group_cols)} if group_cols else {}
    cells = count_cells(df, grid, {"window_start": window_start(ts_col, unit), **groups}, slices)
    return _window_drift(stored(cells), grid, slices, unit)


def _window_drift(cells: DataFrame, grid: Grid, slices: Sequence[str] | None, unit: str) -> DataFrame:
    """Each window of the cells against its predecessor; windows gone after the last one with rows are not reported."""
    groups = ["groups"] if "groups" in cells.columns else []
    cells = by_slice(cells, ["window_start", *groups], len(slices or []))
    keys = ["window_start", *groups, "slice_id", "col_id"]
    at = F.col("window_start")
    last = cells.agg(F.max(at).alias("m")).select("m").scalar()
    shifted = cells.where(at.isNotNull()).withColumn("window_start", shift_window(at, unit))
    baseline = shifted.where(at <= last)
    # a null window equals no other in a join: it gets a day of its own until the end
    none = F.lit("9999-12-31").cast("date")
    paired = _paired(cells, baseline, keys).withColumn("window_start", F.coalesce(at, none))
    out = cell_drift(paired, keys, len(grid.splits))
    when = F.when(at != none, at)
    return _named(out, grid, slices, when.alias("window_start"), shift_window(when, unit, -1).alias("baseline_start"))


def profile_sketched(cells: DataFrame, grid: Grid, slices: Sequence[str] | None = None) -> DataFrame:
    """Counts, nulls, mean, spread and range per window, slice and column from sketches, all exact."""
    groups = ["groups"] if "groups" in cells.columns else []
    keys = ["window_start", *groups, "slice_id", "col_id"]
    s = column_stats(by_slice(cells, ["window_start", *groups], len(slices or [])), keys)
    known = F.col("n") - F.col("nulls")
    out = s.select(
        *keys, F.col("n").alias("row_count"), F.col("nulls").alias("null_count"), "mean",
        F.sqrt(F.try_divide(F.col("m2"), known - 1)).alias("stddev"), F.col("lo").alias("min_value"), F.col("hi").alias("max_value"),
    )
    return _named(out, grid, slices, F.col("window_start"))


class SketchStore:
    """Monthly sketches under ``path``: ``grid`` and ``slices`` as written at creation, one partition a month."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        grid = spark.read.parquet(f"{self.path}/grid").orderBy("place").collect()
        self.grid = Grid(
            {r["column_name"]: list(r["splits"]) for r in grid if r["kind"] == "numeric"},
            [r["column_name"] for r in grid if r["kind"] == "categorical"],
            grid[0]["category_cells"],
        )
        self.slices = [r["column_name"] for r in grid if r["kind"] == "slice"]
        self.groups = [r["column_name"] for r in grid if r["kind"] == "group"]

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, grid: Grid, slices: Sequence[str] = (), group_cols: Sequence[str] = ()
    ) -> SketchStore:
        """A new store; fails if one is there."""
        names = [("numeric", c) for c in grid.splits] + [("categorical", c) for c in grid.categorical]
        names += [("slice", s) for s in slices] + [("group", g) for g in group_cols]
        rows = [(i, kind, c, list(grid.splits.get(c, [])) if kind == "numeric" else [], grid.category_cells) for i, (kind, c) in enumerate(names)]
        schema = "place int, kind string, column_name string, splits array<double>, category_cells int"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/grid")
        return cls(spark, path)

    def append(self, month: DataFrame, year: int, month_number: int) -> None:
        """Sketch one month's rows (``month`` holds no others) and store them as its partition, replacing an earlier one."""
        groups = {"groups": F.struct(*self.groups)} if self.groups else {}
        cells = count_cells(month, self.grid, {**groups}, self.slices)
        cells.write.mode("overwrite").parquet(f"{self._cells()}/window_start={dt.date(year, month_number, 1)}")

    def _cells(self) -> str:
        return f"{self.path}/cells"

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(self._cells())

    def drift(self, year: int, month_number: int, window: str = "1 month") -> DataFrame:
        """One stored month against its predecessor; only their two partitions are read."""
        unit = window_unit(window)
        at = F.lit(dt.date(year, month_number, 1))
        groups = ["groups"] if self.groups else []
        keys = [*groups, "slice_id", "col_id"]
        sides = [by_slice(self.cells().where(F.col("window_start") == w), groups, len(self.slices)) for w in (at, shift_window(at, unit, -1))]
        out = cell_drift(_paired(*sides, keys), keys, len(self.grid.splits))
        return _named(out, self.grid, self.slices, at.alias("window_start"), shift_window(at, unit, -1).alias("baseline_start"))

    def drift_all(self, window: str = "1 month") -> DataFrame:
        """Every stored window against its predecessor; ``window`` may be coarser than a month, sketches then merge."""
        unit = window_unit(window)
        cells = self.cells()
        if unit != "month":
            if unit not in ("quarter", "year"):
                raise ValueError("stored sketches are monthly")
            groups = ["groups"] if self.groups else []
            coarse = cells.withColumn("window_start", window_start("window_start", unit))
            cells = merge_cells(coarse, ["window_start", *groups, "slice_mask", "col_id"])
        return _window_drift(cells, self.grid, self.slices, unit)
