"""Distribution sketches of fixed size, for drift over very wide tables.

A *grid* holds split points for every numeric column, learned once (approximate
quantiles of a baseline, in one aggregate).  A column's sketch is one row per
grid *cell* and (window, groups, slice): count, mean, squared deviations,
smallest and largest value.  Each split point is a cell of its own and each gap
between two neighbours is one, so a column with few values has exact cells.
Categories are dealt to a fixed number of cells by CRC-32; null is cell -1.

* Size: a sketch has at most ``2 * points + 2`` rows whatever the table holds.
  Rows are counted into cells before the shuffle, so what is shuffled depends
  on tasks, windows, columns and cells, never on the number of rows.
* Merging: sketches over one grid add up cell by cell; moments merge pairwise
  (count, mean, M2), which is stable for values far from zero.  A month's
  sketch is final when the month is, so a store of them grows by one partition.
* Slices are one bit each of a row's mask, counted once per mask and given to
  their slices afterwards: a slice does not repeat the rows.

Error: all of a cell's mass lies between its smallest and largest value, and
inside it either CDF may take any monotone course.  With ``d`` the difference
of the CDFs before the cell and ``p_b``, ``p_c`` the two sides' shares in it:

* the true KS statistic lies in ``[ks_stat, ks_stat + ks_error]``: ``ks_stat``
  is the largest difference at the cells' ends, the upper end takes
  ``max(|d + p_b|, |d - p_c|)`` where a cell holds more than one value;
* the true Wasserstein distance differs from ``wasserstein_distance`` (the
  difference taken as linear in a cell) by at most ``wasserstein_error``, the
  sum of ``width * ((p_b + p_c) / 2 + |p_b - p_c| / 4)``.

Both bounds are computed for each comparison, so data that drift out of the
grid show as a wide bound, not as a silent error.  Means, standard deviations,
counts and null rates are exact.  ``js_divergence`` of a numeric column is over
tenths of the baseline cut at cell ends (the exact mode cuts at deciles); of a
categorical column it is exact where no two categories share a cell, else a
lower bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.columns import as_number
from ratelens.operators.drift_metrics import DRIFT_COLUMNS, drift_status, jsd_term, ks_p_value

#: Default number of split points a column, and cells of a categorical column.
POINTS, CATEGORY_CELLS = 64, 1024
MAX_SLICES = 62
#: Partial sketches that a task holds before it gives them out.
TASK_BYTES = 64 << 20
NULL_CELL = -1
CELL_COLUMNS = ["n", "mean", "m2", "lo", "hi"]
SKETCH_DRIFT_COLUMNS = [*DRIFT_COLUMNS, "ks_error", "wasserstein_error"]


@dataclass(frozen=True)
class Grid:
    """Sorted split points of each numeric column, and the categorical columns."""

    splits: Mapping[str, Sequence[float]]
    categorical: Sequence[str] = ()
    category_cells: int = CATEGORY_CELLS

    @property
    def columns(self) -> list[str]:
        return [*self.splits, *self.categorical]

    def borders(self, column: str) -> list[float]:
        """Cell borders: a split point and the next double above it enclose the point's own cell."""
        inner = {b for s in self.splits[column] for b in (s, math.nextafter(s, math.inf))}
        return [-math.inf, *sorted(inner - {-math.inf, math.inf} or {0.0}), math.inf]


def learn_grid(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), points: int = POINTS, accuracy: int = 10_000
) -> Grid:
    """Split points at ``points`` evenly spaced approximate quantiles of each numeric column (rank error 1 / ``accuracy``).

    One aggregate over all columns; the driver gets ``points`` numbers a column.
    """
    if points < 2:
        raise ValueError("a grid needs at least two points")
    if not numeric:
        return Grid({}, list(categorical))
    probs = [i / (points - 1) for i in range(points)]
    cuts = [F.percentile_approx(as_number(df, c), probs, accuracy).alias(f"c{i}") for i, c in enumerate(numeric)]
    row = df.agg(*cuts).first()
    return Grid({c: sorted(set(row[i] or [])) for i, c in enumerate(numeric)}, list(categorical))


def slice_mask(slices: Sequence[str] | None) -> Column:
    """Bit ``i`` is set where slicing predicate ``slices[i]`` (SQL text) holds."""
    if len(slices or []) > MAX_SLICES:
        raise ValueError(f"at most {MAX_SLICES} slices")
    out = F.lit(0).cast("long")
    for i, s in enumerate(slices or []):
        out = out + F.when(F.expr(s), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def count_cells(df: DataFrame, grid: Grid, keys: Mapping[str, Column], slices: Sequence[str] | None = None) -> DataFrame:
    """``(keys..., slice_mask, col_id, cell, n, mean, m2, lo, hi)``: the sketches of every column of the grid.

    Each task counts its rows into cells in numpy, column by column, and gives
    out partial sketches at its end (or before, past ``TASK_BYTES`` of them);
    only these are shuffled, and merged.
    """
    missing = [c for c in grid.columns if c not in df.columns]
    if missing or not grid.columns:
        raise ValueError(f"column(s) {missing} of the grid not in table" if missing else "no column to monitor")
    num = list(grid.splits)
    rows = df.select(
        *[c.alias(name) for name, c in keys.items()],
        slice_mask(slices).alias("slice_mask"),
        *[as_number(df, c).alias(f"_x{i}") for i, c in enumerate(num)],
        *[(F.crc32(F.col(c).cast("string").cast("binary")) % grid.category_cells).cast("int").alias(f"_c{i}") for i, c in enumerate(grid.categorical)],
    )
    names = [*keys, "slice_mask"]
    fields = [rows.schema[n] for n in names]
    schema = T.StructType(
        [*fields, T.StructField("col_id", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in CELL_COLUMNS[1:]]
    )
    partial = rows.mapInArrow(_counter(len(names), [grid.borders(c)[1:-1] for c in num], len(grid.categorical), grid.category_cells), schema)
    return merge_cells(partial, [*names, "col_id"])


def _counter(n_keys: int, inner: list[list[float]], n_cat: int, category_cells: int) -> Callable:
    """The task that counts rows into cells; self-contained, so executors need only numpy and pyarrow."""
    limit, null_cell, names = TASK_BYTES, NULL_CELL, CELL_COLUMNS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cuts = [np.array(c) for c in inner]
        slots = np.array([len(c) + 2 for c in inner] + [category_cells + 1] * n_cat)  # the last one: nulls
        first = np.concatenate([[0], np.cumsum(slots)])
        col_of = np.repeat(np.arange(len(slots)), slots).astype(np.int32)
        cell_of = (np.arange(first[-1]) - first[col_of]).astype(np.int32)
        cell_of[first[1:] - 1] = null_cell
        known: dict = {}
        key_rows: list = []
        state: list = []

        def fresh() -> None:
            known.clear()
            key_rows.clear()
            state[:] = [np.zeros((0, first[-1]), np.int64)] + [np.full((0, first[-1]), f) for f in (0.0, 0.0, np.inf, -np.inf)]

        def results():
            n = state[0]
            at, slot = np.nonzero(n)
            for part in range(0, len(at), 50_000):
                k, sl = at[part : part + 50_000], slot[part : part + 50_000]
                which = pa.array(k)
                heads = pa.Table.from_batches(key_rows).combine_chunks()
                columns = [heads.column(i).take(which).combine_chunks() for i in range(n_keys)]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                columns += [pa.array(col_of[sl]), pa.array(cell_of[sl]), pa.array(n[k, sl])]
                blank = state[3][k, sl] > state[4][k, sl]  # no value: nulls and categories
                columns += [pa.array(v[k, sl], mask=blank) for v in state[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=[*heads.column_names, "col_id", "cell", *names])

        fresh()
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.select(range(n_keys))
            tuples = list(zip(*[[tuple(v.values()) if isinstance(v, dict) else v for v in c.to_pylist()] for c in heads.columns], strict=True))
            code = np.empty(batch.num_rows, np.int64)
            for r, key in enumerate(tuples):
                k = known.get(key)
                if k is None:
                    k = known[key] = len(known)
                    key_rows.append(heads.slice(r, 1))
                code[r] = k
            grow = len(known) - len(state[0])
            if grow:
                state[:] = [
                    np.concatenate([v, np.full((grow, first[-1]), f, v.dtype)]) for v, f in zip(state, (0, 0.0, 0.0, np.inf, -np.inf), strict=True)
                ]
            n, mean, m2, lo, hi = state
            for i, size in enumerate(slots):
                values = batch.column(n_keys + i)
                if i >= len(cuts):
                    cell = values.fill_null(int(size) - 1).to_numpy(zero_copy_only=False)
                    flat, count = np.unique(code * size + cell, return_counts=True)
                    n[flat // size, first[i] + flat % size] += count
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(float)
                none = np.isnan(x)
                cell = np.where(none, size - 1, np.searchsorted(cuts[i], x, side="right"))
                order = np.argsort(code * size + cell, kind="stable")
                flat, x = (code * size + cell)[order], x[order]
                start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                count = np.diff(np.append(start, len(flat)))
                at = (flat[start] // size, first[i] + flat[start] % size)
                some = flat[start] % size != size - 1
                n_new = n[at] + count
                m = np.add.reduceat(x, start) / count
                spread = np.add.reduceat((x - np.repeat(m, count)) ** 2, start)
                low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
                delta = m - mean[at]
                old = n[at]
                n[at] = n_new
                at = tuple(a[some] for a in at)
                share = (count / n_new)[some]
                m2[at] += spread[some] + (delta * delta * old)[some] * share
                mean[at] += delta[some] * share
                lo[at] = np.minimum(lo[at], low[some])
                hi[at] = np.maximum(hi[at], high[some])
            if 40 * n.size > limit:
                yield from results()
                fresh()
        yield from results()

    return run


def merged_moments(parts: Column) -> Column:
    """Struct (n, mean, m2) over an array of such structs, merged pairwise.

    The pairwise update adds deviations, never squares of values, so a small
    spread survives beside large values.
    """
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        delta = b["mean"] - a["mean"]
        both = F.struct(
            n.alias("n"),
            (a["mean"] + delta * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"),
        )
        return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)

    return F.aggregate(parts, zero, merge)


def _moments() -> Column:
    return F.collect_list(F.struct(F.col("n").cast("long").alias("n"), F.col("mean").alias("mean"), F.col("m2").alias("m2")))


def merge_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches added up: one row per ``(keys..., cell)``.  A group of this merge is as large as the number of sketches merged."""
    both = cells.groupBy(*keys, "cell").agg(_moments().alias("_m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    merged = merged_moments(F.filter("_m", lambda m: m["mean"].isNotNull()))
    out = both.withColumn("_m", merged)
    has = F.col("lo").isNotNull()
    return out.select(
        *keys, "cell", "n", F.when(has, F.col("_m.mean")).alias("mean"), F.when(has, F.col("_m.m2")).alias("m2"), "lo", "hi"
    )


def by_slice(cells: DataFrame, keys: Sequence[str], slices: int) -> DataFrame:
    """Cells by slice instead of mask: slice 0 holds all rows, slice ``i`` those of bit ``i - 1``."""
    if not slices:  # one mask
        return cells.select(*keys, F.lit(0).alias("slice_id"), "col_id", "cell", *CELL_COLUMNS)
    ids = F.array(F.lit(0), *[F.when(F.col("slice_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(i + 1)) for i in range(slices)])
    one = cells.withColumn("slice_id", F.explode(F.filter(ids, lambda s: s.isNotNull()))).drop("slice_mask")
    return merge_cells(one, [*keys, "slice_id", "col_id"])


def column_stats(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., n, nulls, mean, m2, lo, hi)`` of a whole column from its cells (at most one list of cells a group)."""
    null = F.col("cell") == NULL_CELL
    out = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(null, F.col("n")).otherwise(0)).alias("nulls"),
        _moments().alias("_m"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    out = out.withColumn("_m", merged_moments(F.filter("_m", lambda m: m["mean"].isNotNull())))
    has = F.col("lo").isNotNull()
    return out.select(
        *keys, "n", "nulls", F.when(has, F.col("_m.mean")).alias("mean"), F.when(has, F.col("_m.m2")).alias("m2"), "lo", "hi"
    )


def cell_drift(paired: DataFrame, keys: Sequence[str], numeric: int) -> DataFrame:
    """Drift metrics per key from paired cells ``(keys..., cell, {n,mean,m2,lo,hi}_b, ..._c)``.

    ``keys`` must hold ``col_id``; ids under ``numeric`` are numeric columns.
    One shuffle by key: the window over a column's cells (at most ``2 * points
    + 2`` rows, or ``category_cells + 1``) and both aggregations share it.
    """
    keys = list(keys)
    is_num = F.col("col_id") < numeric
    null = F.col("cell") == NULL_CELL
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("cell")
    to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what shares are of: known values of a numeric column, all rows of a categorical one
    cells = paired.select(
        "*", *[F.when(is_num & null, 0).otherwise(F.col(f"n_{s}")).alias(f"v_{s}") for s in "bc"]
    ).select(
        *keys, "cell", "n_b", "n_c", "lo_b", "hi_b",
        *[F.struct(F.col(f"n_{s}").alias("n"), F.col(f"mean_{s}").alias("mean"), F.col(f"m2_{s}").alias("m2")).alias(f"m_{s}") for s in "bc"],
        F.least("lo_b", "lo_c").alias("lo"),
        F.greatest("hi_b", "hi_c").alias("hi"),
        F.lead(F.least("lo_b", "lo_c")).over(w).alias("next_lo"),
        F.min("lo_b").over(whole).alias("first_b"),
        F.max("hi_b").over(whole).alias("last_b"),
        *[F.try_divide(f"v_{s}", F.sum(f"v_{s}").over(whole)).alias(f"p_{s}") for s in "bc"],
        *[F.try_divide(F.sum(f"v_{s}").over(to_here), F.sum(f"v_{s}").over(whole)).alias(f"f_{s}") for s in "bc"],
        *[F.try_divide(F.sum(f"v_{s}").over(to_here) - F.col(f"v_{s}"), F.sum(f"v_{s}").over(whole)).alias(f"before_{s}") for s in "bc"],
    )
    d0, d1, pb, pc = F.col("before_b") - F.col("before_c"), F.col("f_b") - F.col("f_c"), F.col("p_b"), F.col("p_c")
    a0, a1, width = F.abs(d0), F.abs(d1), F.col("hi") - F.col("lo")
    inside = F.when(width > 0, F.greatest(F.abs(d0 + pb), F.abs(d0 - pc)))
    # mean of |linear course from d0 to d1|
    course = F.when(d0 * d1 >= 0, (a0 + a1) / 2).otherwise((d0 * d0 + d1 * d1) / (2 * (a0 + a1)))
    gap = F.coalesce(a1 * (F.col("next_lo") - F.col("hi")), F.lit(0.0))
    tenth = (
        F.when(~is_num, F.col("cell"))
        .when(F.col("hi") < F.col("first_b"), -1)
        .when(F.col("lo") > F.col("last_b"), 10)
        .otherwise(F.least(F.floor(F.col("before_b") * 10), F.lit(9)))
    )
    known = F.when(null, 0)
    parts = cells.withColumn("_tenth", tenth).groupBy(*keys, "_tenth").agg(
        *[F.sum(f"p_{s}").alias(f"p_{s}") for s in "bc"],
        *[F.sum(f"n_{s}").alias(f"T{s}") for s in "bc"],
        *[F.sum(known.otherwise(F.col(f"n_{s}"))).alias(f"N{s}") for s in "bc"],
        *[F.collect_list(F.when(F.col(f"m_{s}.mean").isNotNull(), F.col(f"m_{s}"))).alias(f"m_{s}") for s in "bc"],
        F.max(a1).alias("ks"),
        F.max(F.greatest(a1, inside)).alias("ks_high"),
        F.sum(F.coalesce(width * course, F.lit(0.0)) + gap).alias("w"),
        F.sum(width * ((pb + pc) / 2 + F.abs(pb - pc) / 4)).alias("w_error"),
    )
    out = parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("Tb", "Tc", "Nb", "Nc", "w", "w_error")],
        *[F.flatten(F.collect_list(f"m_{s}")).alias(f"m_{s}") for s in "bc"],
        F.max("ks").alias("ks"),
        F.max("ks_high").alias("ks_high"),
        F.sum(jsd_term(F.col("p_b"), F.col("p_c"))).alias("js"),
    )
    out = out.withColumns({f"m_{s}": merged_moments(F.col(f"m_{s}")) for s in "bc"})
    Nb, Nc, Tb, Tc = (F.col(c) for c in ("Nb", "Nc", "Tb", "Tc"))
    ok = is_num & (Nb > 0) & (Nc > 0)
    sd = F.sqrt(F.try_divide(F.col("m_b.m2"), Nb - 1))
    return out.select(
        *keys,
        Nb.alias("n_baseline"),
        Nc.alias("n_current"),
        (F.try_divide(Tc - Nc, Tc) - F.try_divide(Tb - Nb, Tb)).alias("null_rate_delta"),
        F.when(ok, F.abs(F.col("m_c.mean") - F.col("m_b.mean"))).alias("mean_drift"),
        F.when(ok, F.col("ks")).alias("ks_stat"),
        F.when(ok, ks_p_value(F.col("ks"), Nb.cast("double"), Nc.cast("double"))).alias("ks_p_value"),
        F.when(ok, F.col("w")).alias("wasserstein_distance"),
        F.when(ok & (sd > 0), F.col("w") / sd).alias("wasserstein_norm"),
        F.when(ok | (~is_num & (Tb > 0) & (Tc > 0)), F.col("js")).alias("js_divergence"),
        drift_status(Tb, Tc).alias("status"),
        F.when(ok, F.col("ks_high") - F.col("ks")).alias("ks_error"),
        F.when(ok, F.col("w_error")).alias("wasserstein_error"),
    )
