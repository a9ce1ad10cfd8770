import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from scale_factors import SF01
from ratelens.operators.alerts import Rule, alerts
from ratelens.plans import monitor as M
from ratelens.sources.snapshots import SnapshotStore
from ratelens.sources.tables import load_table

APR = dt.date(1997, 4, 1)


def _one(df, column, slice_="all", window=APR):
    rows = df.where((F.col("window_start") == window) & (F.col("column_name") == column) & (F.col("slice") == slice_)).collect()
    assert len(rows) == 1
    return rows[0]


def _months(df, ts):
    start = F.date_trunc("month", ts)
    return df.where((start == F.lit("1997-03-01").cast("timestamp")) | (start == F.lit("1997-04-01").cast("timestamp")))


def test_known_values_sf001(spark):
    li = load_table(spark, SF01, "lineitem")
    d = M.drift_time_series(_months(li, "l_shipdate"), "l_shipdate", ["l_extendedprice"])
    r = _one(d, "l_extendedprice")
    assert (r.n_baseline, r.n_current) == (751, 723)
    assert r.ks_stat == 0.04689367611280859
    assert r.ks_p_value == pytest.approx(0.39269595639132, abs=1e-12)
    assert r.wasserstein_distance == pytest.approx(3000.0056437981, abs=1e-8)
    assert r.js_divergence == pytest.approx(0.00381559045584, abs=1e-12)
    orders = load_table(spark, SF01, "orders")
    d2 = M.drift_time_series(_months(orders, "o_orderdate"), "o_orderdate", ["o_orderpriority"])
    assert _one(d2, "o_orderpriority").js_divergence == pytest.approx(0.011468895200287, abs=1e-12)
    first = d.where(F.col("window_start") == dt.date(1997, 3, 1)).collect()
    assert [r.status for r in first] == ["NO_BASELINE"] and first[0].ks_stat is None


def _snap(spark, b, c, cat=False):
    t = "string" if cat else "double"
    base = spark.createDataFrame([(v,) for v in b], f"x {t}")
    cur = spark.createDataFrame([(v,) for v in c], f"x {t}")
    return M.drift_snapshot(cur, base, ["x"], current_start="2025-04-01", baseline_start="2025-03-01").first()


def test_metric_properties(spark):
    same = _snap(spark, [1.0, 2.0, 2.0, 5.0], [1.0, 2.0, 2.0, 5.0])
    assert (same.ks_stat, same.ks_p_value, same.wasserstein_distance, same.js_divergence) == (0.0, 1.0, 0.0, 0.0)
    disjoint = _snap(spark, [1.0, 2.0, 3.0], [10.0, 11.0])
    assert disjoint.ks_stat == 1.0 and disjoint.js_divergence == pytest.approx(1.0)
    shifted = _snap(spark, [1.0, 4.0, 6.0, 9.0], [3.5, 6.5, 8.5, 11.5])
    assert shifted.wasserstein_distance == pytest.approx(2.5)
    ab, ba = _snap(spark, [1.0, 2.0, 7.0], [2.0, 3.0]), _snap(spark, [2.0, 3.0], [1.0, 2.0, 7.0])
    assert (ab.ks_stat, ab.wasserstein_distance) == pytest.approx((ba.ks_stat, ba.wasserstein_distance))
    cat_same = _snap(spark, ["a", "b", None], ["a", "b", None], cat=True)
    assert cat_same.js_divergence == 0.0 and cat_same.ks_stat is None
    cat_disjoint = _snap(spark, ["a", "a"], ["b", None], cat=True)
    assert cat_disjoint.js_divergence == pytest.approx(1.0) and cat_disjoint.null_rate_delta == 0.5
    cab, cba = _snap(spark, ["a", "b", "b"], ["a", "c"], True), _snap(spark, ["a", "c"], ["a", "b", "b"], True)
    assert cab.js_divergence == pytest.approx(cba.js_divergence)


def test_bucketed_drift_equals_plain(spark):
    li = load_table(spark, SF01, "lineitem")
    cols = ["l_extendedprice", "l_quantity", "l_returnflag"]
    a = M.drift_time_series(li, "l_shipdate", cols, buckets=1, mean_scale=4)
    b = M.drift_time_series(li, "l_shipdate", cols, buckets=5, mean_scale=4)
    key = ["window_start", "column_name", "slice"]
    ra = {tuple(r[k] for k in key): r for r in a.collect()}
    rb = {tuple(r[k] for k in key): r for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        for f in ("n_baseline", "n_current", "ks_stat", "status"):
            assert ra[k][f] == rb[k][f]
        for f in ("wasserstein_distance", "js_divergence", "ks_p_value"):
            if ra[k][f] is None or rb[k][f] is None:
                assert ra[k][f] is rb[k][f]
            else:
                assert ra[k][f] == pytest.approx(rb[k][f], rel=1e-9, abs=1e-12)


def test_three_layouts_agree(spark, scratch):
    """Time series, separate monthly tables, and overwrite-with-baseline-capture give the same drift."""
    li = load_table(spark, SF01, "lineitem").withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
    cols = ["l_extendedprice", "l_discount", "l_returnflag"]
    ts = M.drift_time_series(_months(li, "l_shipdate"), "l_shipdate", cols, mean_scale=4).where(F.col("window_start") == APR)

    def resolve(y, m):
        return li.where((F.col("year") == y) & (F.col("month") == m))

    sep = M.drift_separate(resolve, [(1997, 4)], cols, mean_scale=4)
    store = SnapshotStore(spark, f"{scratch}/baseline")
    store.capture(li, 1997, 3)  # baseline captured before the table is overwritten with April
    snap = M.drift_snapshot(resolve(1997, 4), store.as_of("1997-03-31"), cols, None, "1997-04-01", "1997-03-01", mean_scale=4)
    key = lambda r: r.column_name
    first, *others = [sorted(d.collect(), key=key) for d in (ts, sep, snap)]
    for rows in others:
        assert len(rows) == len(first) == len(cols)
        for a, b in zip(first, rows, strict=True):
            # double sums over several partitions differ in the last bit by the order they are added in
            for x, y in zip(a, b, strict=True):
                assert (y == pytest.approx(x, rel=1e-12, abs=1e-15)) if isinstance(x, float) else x == y


def test_slices_alerts_profile_custom(spark):
    li = _months(load_table(spark, SF01, "lineitem"), "l_shipdate")
    d = M.drift_time_series(li, "l_shipdate", ["l_extendedprice", "l_returnflag"], slices=["l_returnflag = 'R'"])
    assert {r.slice for r in d.collect()} == {"all", "l_returnflag = 'R'"}
    rules = [Rule("w", "wasserstein_distance", "wasserstein_distance > 0.05"), Rule("never", "ks_stat", "ks_stat > 2")]
    fired = alerts(d, rules).collect()
    assert {r.rule for r in fired} == {"w"} and all(r.metric_value > 0.05 for r in fired)
    p = M.profile(li, "l_shipdate", ["l_extendedprice", "l_returnflag"])
    r = p.where((F.col("window_start") == APR) & (F.col("column_name") == "l_extendedprice") & (F.col("slice") == "all")).first()
    assert (r.row_count, r.null_count, r.distinct_count) == (723, 0, 723)
    assert r.p50 == pytest.approx(55540.56)
    cm = M.custom_metric_drift(li, "l_shipdate", {"n": "count(*)"}).where(F.col("window_start") == APR).first()
    assert (cm.baseline_value, cm.current_value, cm.delta) == (751.0, 723.0, -28.0)


def test_hash_sample_deterministic(spark):
    li = load_table(spark, SF01, "lineitem")
    a = M.hash_sample(li, ["l_orderkey", "l_linenumber"], 0.3)
    b = M.hash_sample(li.repartition(7), ["l_orderkey", "l_linenumber"], 0.3)
    ka = sorted(tuple(r) for r in a.select("l_orderkey", "l_linenumber").collect())
    kb = sorted(tuple(r) for r in b.select("l_orderkey", "l_linenumber").collect())
    assert ka == kb and 0.25 < len(ka) / li.count() < 0.35


def test_window_units():
    assert M.window_unit("1 MONTH") == "month" and M.window_unit("week") == "week" and M.window_unit("1 days") == "day"
    with pytest.raises(ValueError):
        M.window_unit("2 months")


def test_group_cols_equal_slices(spark):
    li = _months(load_table(spark, SF01, "lineitem"), "l_shipdate")
    cols = ["l_extendedprice", "l_linestatus"]
    by_group = M.drift_time_series(li, "l_shipdate", cols, group_cols=["l_returnflag"], mean_scale=4)
    assert by_group.columns[:4] == ["window_start", "baseline_start", "slice", "l_returnflag"]
    by_slice = M.drift_time_series(li, "l_shipdate", cols, slices=["l_returnflag = 'R'"], mean_scale=4)
    a = sorted(tuple(r)[4:] for r in by_group.where("l_returnflag = 'R'").collect())
    b = sorted(tuple(r)[3:] for r in by_slice.where("slice = \"l_returnflag = 'R'\"").collect())
    assert a == b and len(a) == 4


def test_windows_before_1970(spark):
    rows = [(dt.datetime(1969, 11, 5), 1.0, "a"), (dt.datetime(1969, 12, 5), 2.0, "b"), (dt.datetime(1970, 1, 5), 2.0, "b")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double, c string")
    d = M.drift_time_series(df, "ts", ["x", "c"], slices=["c = 'b'"])
    got = {(r.window_start, r.slice, r.column_name) for r in d.collect()}
    assert (dt.date(1969, 12, 1), "c = 'b'", "x") in got and (dt.date(1969, 11, 1), "all", "c") in got
    r = d.where((F.col("window_start") == dt.date(1969, 12, 1)) & (F.col("slice") == "all") & (F.col("column_name") == "x")).first()
    assert (r.ks_stat, r.wasserstein_distance) == (1.0, 1.0)


def test_columns_per_pass_equals_one_pass(spark):
    li = _months(load_table(spark, SF01, "lineitem"), "l_shipdate")
    cols = ["l_extendedprice", "l_quantity", "l_returnflag"]
    one = M.drift_time_series(li, "l_shipdate", cols, mean_scale=4)
    two = M.drift_time_series(li, "l_shipdate", cols, mean_scale=4, columns_per_pass=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_null_groups_null_times_and_gone_groups(spark):
    rows = [
        *[("2025-03-05", None, float(v), "u") for v in range(4)],
        *[("2025-04-05", None, float(v + 1), "u") for v in range(4)],
        ("2025-03-06", "b", 1.0, "u"),
        ("2025-06-06", "c", 2.0, "w"),
        (None, "c", 9.0, "w"),
    ]
    df = spark.createDataFrame(rows, "d string, g string, x double, s string").withColumn("ts", F.col("d").cast("timestamp"))
    got = M.drift_time_series(df, "ts", ["x", "s"], group_cols=["g"]).collect()
    by = {(str(r.window_start), r.g, r.column_name): r for r in got}
    april = by["2025-04-01", None, "x"]
    assert (april.n_baseline, april.n_current, april.status, april.ks_stat) == (4, 4, "OK", 0.25)
    assert april.wasserstein_distance == pytest.approx(1.0) and april.js_divergence is not None
    assert by["2025-04-01", None, "s"].js_divergence == 0.0
    assert by["2025-04-01", "b", "x"].status == "NO_CURRENT" and by["2025-05-01", None, "s"].status == "NO_CURRENT"
    assert by["None", "c", "x"].status == "NO_BASELINE" and by["None", "c", "x"].baseline_start is None
    assert max(str(r.window_start) for r in got if r.window_start) == "2025-06-01"
    assert len(got) == 2 * 7
    gone = alerts(M.drift_time_series(df, "ts", ["x"], group_cols=["g"]), [Rule("gone", "n_current", "status = 'NO_CURRENT'")])
    assert gone.count() == 2
    p = {(str(r.window_start), r.g): r for r in M.profile(df, "ts", ["x"], group_cols=["g"]).collect()}
    assert p["2025-03-01", None].p50 == 1.5 and p["None", "c"].row_count == 1


def test_asked_columns_are_monitored_or_refused(spark):
    df = spark.createDataFrame([(1.0, dt.date(2025, 3, 1), 2025, b"x")], "x double, dd date, year int, raw binary")
    assert M.split_columns(df, ["x", "year"]) == (["x", "year"], [])
    assert M.split_columns(df, None) == (["x", "dd"], [])
    with pytest.raises(ValueError):
        M.split_columns(df, ["x", "raw"])


def test_dates_drift_in_days(spark):
    rows = [(dt.date(2025, 1, 1), dt.date(2024, 1, 1 + k)) for k in range(4)] + [(dt.date(2025, 2, 1), dt.date(2024, 1, 11 + k)) for k in range(4)]
    df = spark.createDataFrame(rows, "t date, d date").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    got = {r.column_name: r for r in M.drift_time_series(df, "t").where("status = 'OK'").collect()}
    assert set(got) == {"d", "ts"} and all(r.wasserstein_distance == pytest.approx(10.0) for r in got.values())


def _read_counted(spark, rows, schema):
    """A table that counts how many of its rows are read."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), schema), read


def test_counts_come_from_one_read(spark):
    rows = [(dt.datetime(2025, m, 5), float(v * m)) for m in (1, 2, 3) for v in range(20)]
    df, read = _read_counted(spark, rows, "ts timestamp_ntz, x double")
    assert M.drift_time_series(df, "ts", ["x"]).count() == 3
    assert read.value == len(rows)


def test_ranges_of_values_equal_brute_force(spark):
    """Ties, nulls, a hot value, empty ranges and a null group, in one range and in many."""
    rng = np.random.default_rng(3)
    rows = []
    for m, shift in ((1, 0.0), (2, 5.0), (4, 40.0)):
        for g in ("a", None):
            x = np.round(rng.normal(shift, 20, 300), 1)
            x[:100] = 7.0
            rows += [(dt.datetime(2025, m, 5), g, float(v)) for v in x] + [(dt.datetime(2025, m, 5), g, None)] * 3
    df = spark.createDataFrame(rows, "ts timestamp_ntz, g string, x double")
    for buckets in (1, 5, 37):
        got = {(r.window_start.month, r.g): r for r in M.drift_time_series(df, "ts", ["x"], group_cols=["g"], buckets=buckets).collect()}
        assert set(got) == {(m, g) for m in (1, 2, 3, 4) for g in ("a", None)}
        for g in ("a", None):
            b, c = (np.sort([r[2] for r in rows if r[0].month == m and r[1] == g and r[2] is not None]) for m in (1, 2))
            x = np.unique(np.concatenate([b, c]))
            gap = np.abs(np.searchsorted(b, x, "right") / len(b) - np.searchsorted(c, x, "right") / len(c))
            edges = np.unique([b[0], *np.quantile(b, np.arange(1, 10) / 10)])
            bins = [np.where(s > b[-1], 99, np.searchsorted(edges, s, "right")) for s in (b, c)]
            p, q = (np.bincount(k, minlength=100) / len(k) for k in bins)
            both = (p + q) / 2
            js = sum(0.5 * (s[s > 0] * np.log2(s[s > 0] / both[s > 0])).sum() for s in (p, q))
            r = got[2, g]
            assert (r.status, r.n_baseline, r.n_current, r.ks_stat) == ("OK", 300, 300, gap.max())
            assert r.wasserstein_distance == pytest.approx((gap[:-1] * np.diff(x)).sum())
            assert r.wasserstein_norm == pytest.approx((gap[:-1] * np.diff(x)).sum() / b.std(ddof=1))
            assert r.js_divergence == pytest.approx(js)
            assert got[3, g].status == "NO_CURRENT" and got[4, g].status == "NO_BASELINE" and got[4, g].ks_stat is None


def test_monthly_tables_are_written_in_one_read(spark, monkeypatch):
    from ratelens.plans import catalogue as C

    rows = [(dt.datetime(2025, m, 5), float(v * m), "R") for m in (1, 2, 3, 5) for v in range(10)] + [(None, 1.0, "R")]
    df, read = _read_counted(spark, rows, "l_shipdate timestamp_ntz, l_extendedprice double, l_returnflag string")
    monkeypatch.setattr(C, "_li", lambda spark, sf_dir: df)
    got = C.QUERIES["d03_drift_separate_monthly_tables"](spark, "").collect()
    status = {(r.window_start.month, r.column_name): r.status for r in got}
    assert status == {
        (m, c): s
        for m, s in ((1, "NO_BASELINE"), (2, "OK"), (3, "OK"), (4, "NO_CURRENT"), (5, "NO_BASELINE"))
        for c in ("l_extendedprice", "l_returnflag")
    }
    # the range of months, and the write
    assert read.value == 2 * len(rows)
