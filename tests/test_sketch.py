import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from plan_metrics import metric
from ratelens.operators import sketch as S
from ratelens.plans import monitor as M
from ratelens.plans import wide_monitor as W
from ratelens.sources.snapshots import SnapshotStore
from ratelens.sources.tables import load_table
from scale_factors import SF01

COLUMNS = ["l_extendedprice", "l_discount", "l_orderkey", "l_returnflag"]
SLICES = ["l_linestatus = 'O'"]


def _by_key(df):
    return {(r["window_start"], r["slice"], r["column_name"]): r for r in df.collect()}


def _close(a, b, **kw):
    return (a is None and b is None) or a == pytest.approx(b, **kw)


def test_bounds_hold_against_exact(spark):
    li = load_table(spark, SF01, "lineitem")
    exact = _by_key(M.drift_time_series(li, "l_shipdate", COLUMNS, SLICES))
    ours = _by_key(W.drift_sketched(li, "l_shipdate", columns=COLUMNS, slices=SLICES, points=24))
    assert exact.keys() == ours.keys()
    seen = 0
    for k, e in exact.items():
        o = ours[k]
        assert (e["n_baseline"], e["n_current"], e["status"]) == (o["n_baseline"], o["n_current"], o["status"])
        assert _close(o["mean_drift"], e["mean_drift"], abs=1e-6) and _close(o["null_rate_delta"], e["null_rate_delta"])
        if e["ks_stat"] is None:
            assert o["ks_stat"] is None and o["ks_error"] is None
        else:
            seen += 1
            assert o["ks_stat"] - 1e-12 <= e["ks_stat"] <= o["ks_stat"] + o["ks_error"] + 1e-12
            assert abs(e["wasserstein_distance"] - o["wasserstein_distance"]) <= o["wasserstein_error"] + 1e-9
            assert o["js_divergence"] == pytest.approx(e["js_divergence"], abs=0.06)
        if k[2] == "l_discount":  # fewer values than points: every cell is exact
            assert (o["ks_error"], o["wasserstein_error"]) in ((0.0, 0.0), (None, None))
        if k[2] == "l_returnflag":
            assert _close(o["js_divergence"], e["js_divergence"], abs=1e-12)
    assert seen > 400


def test_shuffle_does_not_grow_with_rows(spark):
    """Ten times the rows in as many tasks: as many rows shuffled."""
    shuffled = []
    for times in (1, 10):
        df = spark.range(0, 80_000 * times, numPartitions=4).select(
            F.make_date(F.lit(2024), (F.col("id") % 3 + 1).cast("int"), F.lit(1)).alias("d"),
            *[(F.col("id") % 2000 * (i + 1)).cast("double").alias(f"x{i}") for i in range(100)],
            (F.col("id") % 5).cast("string").alias("s"),
        )
        grid = S.Grid({f"x{i}": [200.0 * (i + 1) * k for k in range(9)] for i in range(100)}, ["s"])
        cells = S.count_cells(df, grid, {"window_start": F.col("d")})
        cells.collect()
        shuffled.append(metric(cells, "Exchange", "shuffleRecordsWritten"))
    assert shuffled[0] == shuffled[1] <= 4 * 3 * (100 * 20 + 6)


def test_partial_sketches_merge(spark, monkeypatch):
    """Given out early, from many tasks, or all at once: the same sketches."""
    li = load_table(spark, SF01, "lineitem").where("l_shipdate < '1995-06-01'")
    grid = W.make_grid(li, COLUMNS, points=9)
    keys = {"window_start": M.window_start("l_shipdate", "month")}

    def rows(df):
        return {(r["window_start"], r["slice_mask"], r["col_id"], r["cell"]): r for r in S.count_cells(df, grid, keys, SLICES).collect()}

    one = rows(li.coalesce(1))
    monkeypatch.setattr(S, "TASK_BYTES", 1)
    many = rows(li.repartition(7))
    assert one.keys() == many.keys()
    for k, a in one.items():
        b = many[k]
        assert (a["n"], a["lo"], a["hi"]) == (b["n"], b["lo"], b["hi"])
        assert _close(a["mean"], b["mean"], rel=1e-12) and _close(a["m2"], b["m2"], rel=1e-9, abs=1e-9)


def test_cells_match_brute_force(spark):
    rnd = random.Random(4)
    values = [None, math.nan, -0.0, 0.0, math.inf, -5.0, 2.0, 2.0] + [round(rnd.gauss(2, 3), 1) for _ in range(400)]
    df = spark.createDataFrame([(v, rnd.choice([None, "a", "b"])) for v in values], "x double, s string").repartition(3)
    grid = S.Grid({"x": [-1.0, 0.0, 2.0, 6.5]}, ["s"])
    got = {(r["col_id"], r["cell"]): r for r in S.count_cells(df, grid, {}).collect()}
    want = {}
    for v in values:
        if v is None or v != v:
            cell = S.NULL_CELL
        else:
            cell = sum((p < v) + (p <= v) for p in grid.splits["x"])
        want.setdefault(cell, []).append(v)
    assert {c for i, c in got if i == 0} == set(want)
    for cell, vs in want.items():
        r = got[0, cell]
        assert r["n"] == len(vs)
        if cell == S.NULL_CELL:
            assert r["lo"] is None and r["mean"] is None
        else:
            assert (r["lo"], r["hi"]) == (min(vs), max(vs))
            if math.isfinite(max(vs)):
                mean = math.fsum(vs) / len(vs)
                assert r["mean"] == pytest.approx(mean) and r["m2"] == pytest.approx(math.fsum((v - mean) ** 2 for v in vs), abs=1e-9)
    assert sum(r["n"] for (i, _), r in got.items() if i == 1) == len(values)


def test_moments_are_stable_far_from_zero(spark):
    df = spark.range(0, 3000, numPartitions=5).select((F.lit(1e12) + F.col("id") % 3).alias("x"), F.lit(1).alias("k"))
    grid = S.Grid({"x": [1e12 + 0.5, 1e12 + 1.5]})
    r = S.column_stats(S.count_cells(df, grid, {"k": F.col("k")}), ["k", "col_id"]).first()
    assert r["mean"] == 1e12 + 1 and math.sqrt(r["m2"] / 2999) == pytest.approx(0.8166326)


def test_months_arrive_one_at_a_time(spark, scratch):
    """A new month reads its own rows only; stored drift equals the full run's."""
    li = load_table(spark, SF01, "lineitem")
    source = SnapshotStore(spark, f"{scratch}/source")
    months = (2, 3, 4)
    for m in months:
        start = dt.datetime(1997, m, 1)
        source.capture(li.where((F.col("l_shipdate") >= F.lit(start)) & (F.col("l_shipdate") < F.lit(dt.datetime(1997, m + 1, 1)))), 1997, m)
    grid = W.make_grid(source.month(1997, 2), COLUMNS, points=16)
    store = W.SketchStore.create(spark, f"{scratch}/sketches", grid, SLICES, ["l_shipmode"] if "l_shipmode" in li.columns else [])
    for m in months:
        store.append(source.month(1997, m), 1997, m)
        store.append(source.month(1997, m), 1997, m)  # again: replaced
    april = S.count_cells(source.month(1997, 4), grid, {})
    april.collect()
    assert metric(april, "FileScan", "numOutputRows") == source.month(1997, 4).count() < source.read().count()
    again = W.SketchStore(spark, f"{scratch}/sketches")
    drift = again.drift(1997, 4)
    full = W.drift_sketched(source.read(), "l_shipdate", grid, slices=SLICES).where("window_start = DATE '1997-04-01'")
    fields = [c for c in drift.columns if c not in ("slice", "column_name")]
    a, b = _by_key(drift), _by_key(full)
    assert a.keys() == b.keys() and len(a) == 8
    for k in a:
        assert all(_close(a[k][f], b[k][f], rel=1e-9, abs=1e-12) if isinstance(a[k][f], float) else a[k][f] == b[k][f] for f in fields)
    plan = drift._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(window_start") >= 2
    with pytest.raises(Exception):
        W.SketchStore.create(spark, f"{scratch}/sketches", grid)


def test_coarser_windows_merge(spark, scratch):
    li = load_table(spark, SF01, "lineitem").where("l_shipdate >= '1996-01-01' AND l_shipdate < '1996-07-01'")
    grid = W.make_grid(li, ["l_extendedprice"], points=12)
    store = W.SketchStore.create(spark, f"{scratch}/q", grid)
    for m in range(1, 7):
        store.append(li.where(F.month("l_shipdate") == m), 1996, m)
    a = _by_key(store.drift_all("quarter"))
    b = _by_key(W.drift_sketched(li, "l_shipdate", grid, window="quarter"))
    assert a.keys() == b.keys() and len(a) == 2
    for k in a:
        for f in ("ks_stat", "ks_error", "wasserstein_distance", "mean_drift", "js_divergence"):
            assert _close(a[k][f], b[k][f], rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError):
        store.drift_all("day")


def test_null_windows_groups_gone_months_dates_and_empty(spark):
    rows = [(dt.date(2025, 1, 1), "a", dt.date(2024, 12, 1), 1.0), (dt.date(2025, 1, 2), None, dt.date(2024, 12, 9), 2.0)]
    rows += [(dt.date(2025, 3, 1), "a", None, 5.0), (None, "a", dt.date(2024, 1, 1), 1.0), (dt.date(2025, 2, 1), None, dt.date(2025, 2, 1), 2.0)]
    df = spark.createDataFrame(rows, "t date, g string, d date, x double")
    out = W.drift_sketched(df, "t", group_cols=["g"]).collect()
    got = {(r["window_start"], r["g"], r["column_name"]): r["status"] for r in out}
    feb, mar = dt.date(2025, 2, 1), dt.date(2025, 3, 1)
    assert got[None, "a", "d"] == "NO_BASELINE" and got[feb, "a", "x"] == "NO_CURRENT" and got[feb, None, "d"] == "OK"
    assert got[mar, "a", "x"] == "NO_BASELINE" and got[mar, None, "x"] == "NO_CURRENT"
    assert max(k[0] for k in got if k[0]) == mar
    assert W.drift_sketched(df.where("x > 99"), "t", S.Grid({"x": [1.0]})).count() == 0
    p = {(r["window_start"], r["column_name"]): r for r in W.profile_sketched(S.count_cells(df, S.Grid({"x": [2.0], "d": []}), {"window_start": M.window_start("t", "month")}), S.Grid({"x": [2.0], "d": []})).collect()}
    jan = p[dt.date(2025, 1, 1), "x"]
    assert (jan["row_count"], jan["null_count"], jan["mean"], jan["min_value"], jan["max_value"]) == (2, 0, 1.5, 1.0, 2.0)
    assert p[mar, "d"]["null_count"] == 1 and p[mar, "d"]["mean"] is None
