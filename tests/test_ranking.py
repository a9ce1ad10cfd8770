import functools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ratelens.operators import ranking
from ratelens.operators.ranking import exact_quantiles, ntile_summary, ordered_prefix, value_counts


def _ntile_reference(df, col, n=10):
    w = df.where(F.col(col).isNotNull()).withColumn("t", F.ntile(n).over(Window.orderBy(col)))
    rows = (
        w.groupBy("t")
        .agg(F.count("*"), F.min(col), F.max(col), F.sum(F.col(col).cast("decimal(18,4)")).cast("double"))
        .orderBy("t")
        .collect()
    )
    return [tuple(r) for r in rows]


def _ntile_ours(df, col, n=10):
    rows = (
        ntile_summary(df, col, n, tile_name="t")
        .select("t", "n_rows", "min_value", "max_value", "sum_value")
        .orderBy("t")
        .collect()
    )
    return [tuple(r) for r in rows]


LEAF = ranking.LEAF_ROWS


def _small_leaves(monkeypatch, leaf):
    """Few rows, but as if there were too many to look at."""
    monkeypatch.setattr(ranking, "order_statistics", functools.partial(ranking.order_statistics, leaf_rows=leaf))


CASES = {
    "distinct": [(float(i * 7 % 1001),) for i in range(1001)],
    "heavy_ties": [(float(i % 9),) for i in range(2000)] + [(5.0,)] * 1000,
    "constant": [(3.5,)] * 57,
    "tiny": [(float(v),) for v in (4, 1, 9, 9, 2, 7, 3)],
    "nulls": [(None,)] * 5 + [(float(i % 13),) for i in range(300)],
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("leaf", [LEAF, 1])
def test_ntile_summary_matches_window_ntile(spark, case, leaf, monkeypatch):
    _small_leaves(monkeypatch, leaf)
    df = spark.createDataFrame(CASES[case], "x double")
    assert _ntile_ours(df, "x", 10) == _ntile_reference(df, "x", 10)


def test_ntile_counts_a_column(spark):
    """Of equal values, rows that have the counted column come first."""
    df = spark.createDataFrame([(float(i % 4), None if i % 3 == 0 else str(i)) for i in range(101)], "x double, r string")
    w = Window.orderBy("x", F.col("r").isNull())
    want = df.withColumn("t", F.ntile(7).over(w)).groupBy("t").agg(F.count("r")).collect()
    got = ntile_summary(df, "x", 7, tile_name="t", counted="r").select("t", "n_counted").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("typ", ["double", "long", "decimal(12,2)"])
def test_order_statistics_split_brackets(spark, typ):
    """Accuracy too coarse for the ranks, no leaves: brackets split until each rank is hit."""
    rnd = random.Random(1)
    values = [round(rnd.lognormvariate(5, 3)) for _ in range(3000)] + [7] * 1500 + [-1, 0, 0]
    col = spark.createDataFrame([(float(v),) for v in values], "x double").select(F.col("x").cast(typ).alias("x")).repartition(5).cache()
    ranks = [0, 1, 2, 3, 700, 1499, 1503, 2000, 4400, 4501, 4502]
    before = ranking.ACCURACY
    ranking.ACCURACY = 20
    try:
        got = ranking.order_statistics(col, "x", len(values), ranks, leaf_rows=0)
        leaf = ranking.order_statistics(col, "x", len(values), ranks, leaf_rows=300)
    finally:
        ranking.ACCURACY = before
    want = sorted(values)
    assert {r: float(v) for r, v in got.items()} == {r: want[r] for r in ranks} == {r: float(v) for r, v in leaf.items()}


def test_ntile_summary_empty(spark):
    df = spark.createDataFrame([], "x double")
    assert _ntile_ours(df, "x") == []


@pytest.mark.parametrize("case", ["distinct", "heavy_ties", "tiny", "nulls"])
@pytest.mark.parametrize("leaf", [LEAF, 0])
def test_exact_quantiles_match_percentile(spark, case, leaf, monkeypatch):
    _small_leaves(monkeypatch, leaf)
    df = spark.createDataFrame(CASES[case], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    ours = exact_quantiles(df, "x", probs).first()[0]
    ref = df.selectExpr(f"percentile(x, array({', '.join(map(str, probs))}))").first()[0]
    assert ours == pytest.approx(ref, rel=1e-12, abs=1e-12)


def test_exact_quantiles_keyed_and_empty(spark):
    rows = [(k, float(v)) for k in ("a", "b") for v in range(k == "a" and 11 or 4)]
    df = spark.createDataFrame(rows, "k string, x double")
    ours = {r.k: r.q for r in exact_quantiles(df, "x", [0.5], keys=["k"], name="q").collect()}
    assert ours == {"a": [5.0], "b": [1.5]}
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, "x", [0.5]).first()[0] == [None]


def test_prefix_by_ranges_equals_one_partition(spark):
    rows = [(k, float(v), v % 3 + 1) for k in ("a", "b", "c") for v in range(0, 400, 1 + "abc".index(k))]
    vc = spark.createDataFrame(rows, "k string, value double, n long")
    plain = ordered_prefix(vc, ["k"], "value", ["n"], partitions=1)
    bucketed = ordered_prefix(vc, ["k"], "value", ["n"], partitions=7)
    cols = ["k", "value", "n", "cum_n", "tot_n", "next_value"]
    a = sorted(tuple(r) for r in plain.select(cols).collect())
    b = sorted(tuple(r) for r in bucketed.select(cols).collect())
    assert a == b


def test_result_independent_of_shuffle_partitions(spark):
    df = spark.createDataFrame(CASES["heavy_ties"], "x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _ntile_ours(df, "x", 10)
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = _ntile_ours(df, "x", 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_value_counts_drop_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (1.0,)], "x double")
    assert [tuple(r) for r in value_counts(df, [], "x").collect()] == [(1.0, 2)]


@pytest.mark.parametrize("case", ["distinct", "heavy_ties", "constant", "tiny", "nulls"])
def test_distribution_stats_match_aggregates(spark, case):
    from ratelens.operators.ranking import distribution_stats

    df = spark.createDataFrame(CASES[case], "x double")
    ours = distribution_stats(df, "x", [0.25, 0.5]).first()
    ref = df.selectExpr("min(x)", "max(x)", "avg(x)", "stddev(x)", "percentile(x, array(0.25, 0.5))").first()
    assert (ours["min"], ours["max"]) == (ref[0], ref[1])
    assert ours["mean"] == pytest.approx(ref[2], rel=1e-12)
    if ref[3] is None:
        assert ours["stddev"] is None
    else:
        assert ours["stddev"] == pytest.approx(ref[3], rel=1e-9, abs=1e-12)
    assert ours["quantiles"] == pytest.approx(ref[4], rel=1e-12)


def test_distribution_stats_empty(spark):
    from ratelens.operators.ranking import distribution_stats

    r = distribution_stats(spark.createDataFrame([], "x double"), "x", [0.5]).first()
    assert (r["min"], r["max"], r["mean"], r["stddev"]) == (None, None, None, None)
