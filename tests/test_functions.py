import pytest
from pyspark.sql import functions as F

from ratelens.functions.expr import any_true, first_word, money_avg, money_sum, null_inclusive_distinct, safe_ratio
from ratelens.plans.reports import growth_bucket


def test_growth_bucket_edges(spark):
    vals = [-10.1, -10.0, -0.01, -0.005, 0.0, 10.0, 10.1, None]
    df = spark.createDataFrame([(v,) for v in vals], "g double")
    got = [r[0] for r in df.select(growth_bucket(F.col("g"))).collect()]
    assert got == [
        "Significant Decrease", "Moderate Decrease", "Moderate Decrease", "No Change",
        "Moderate Increase", "Moderate Increase", "Significant Increase", "No Change",
    ]


def test_any_true_is_three_valued(spark):
    df = spark.createDataFrame([(None, 30.0), (None, None), (1.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(any_true([F.col("a") > 25, F.col("b") > 25])).collect()]
    assert got == [True, None, False]
    assert df.where(any_true([F.col("a") > 25, F.col("b") > 25])).count() == 1


def test_first_word_edges(spark):
    df = spark.createDataFrame([("ford focus",), ("",), (" lead",), (None,)], "s string")
    assert [r[0] for r in df.select(first_word("s")).collect()] == ["ford", "", "", None]


def test_null_inclusive_distinct(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "s string")
    assert df.agg(null_inclusive_distinct("s")).first()[0] == df.select("s").distinct().count() == 3


def test_safe_ratio_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (3.0, 2.0), (1.0, None)], "n double, d double")
    assert [r[0] for r in df.select(safe_ratio("n", "d")).collect()] == [None, None, 1.5, None]


def test_money_sum_is_partitioning_independent(spark):
    rows = [(x * 0.01 + 0.07,) for x in range(5000)]
    df = spark.createDataFrame(rows, "x double")
    a = df.repartition(1).agg(money_sum("x", 4), money_avg("x", 4)).first()
    b = df.repartition(13).agg(money_sum("x", 4), money_avg("x", 4)).first()
    assert tuple(a) == tuple(b)
    assert abs(a[0] - sum(round(r[0], 4) for r in rows)) < 1e-6


def test_sums_keep_small_rates_and_large_amounts(spark):
    df = spark.createDataFrame([(0.000004, 1e15), (0.000006, 3e15)], "r double, a double")
    got = df.agg(money_avg("r"), money_sum("a"), money_sum("r")).first()
    assert tuple(got) == (pytest.approx(5e-06, rel=1e-12), 4e15, pytest.approx(1e-05, rel=1e-12))
