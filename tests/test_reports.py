from pyspark.sql import functions as F

from scale_factors import SF001
from ratelens.plans import reports as R
from ratelens.sources.policy import policy_frame


def test_run_all_builds_every_report(spark):
    out = R.run_all(policy_frame(spark, SF001), cache=True)
    assert out["skipped"] == []
    assert set(out["results"]) == set(R.CATALOGUE)
    for name in ("state_premium", "decile_summary", "growth_summary", "renewal_data"):
        assert out["results"][name].count() > 0
    out["source"].unpersist()


def test_summary_statistics_equals_describe(spark):
    df = policy_frame(spark, SF001)
    ours, ref = R.summary_statistics(df).collect(), df.describe().collect()
    assert [r.summary for r in ours] == [r.summary for r in ref]
    for a, b in zip(ours, ref):
        for k in b.asDict():
            x, y = a[k], b[k]
            if x != y:
                assert abs(float(x) - float(y)) <= 1e-9 * max(1.0, abs(float(y))), (a.summary, k, x, y)


def test_missing_optional_columns_are_skipped(spark):
    df = policy_frame(spark, SF001).drop("cty_nm", "waiv_comm_amt", "new_ren_cd", *R.QUARTER_COLUMNS, *R.VEHICLE_COLUMNS)
    out = R.run_all(df)
    for name in ("top_cities", "waived_commission_by_state", "renewal_data", "quarterly_patterns", "vehicle_data"):
        assert name in out["skipped"]


def test_quarter_gap_labels_count_positions(spark):
    df = policy_frame(spark, SF001).drop("cy_qtr2_wprm_amt")
    v = R.quarterly_variation(df)
    assert [c for c in v.columns if c.startswith("variation_")][:2] == ["variation_1_to_2", "variation_2_to_3"]


def test_rate_bands_all_null(spark):
    df = policy_frame(spark, SF001).withColumn("bas_rt", F.lit(None).cast("double"))
    assert R.rate_bands(df).count() == 0


def test_reports_prune_columns(spark):
    plan = R.state_earned_premium(policy_frame(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln and "lineitem.parquet" in ln][0]
    cols = [c.split("#")[0] for c in scan.split("FileScan parquet [")[1].split("]")[0].split(",")]
    # rec_id (counted) needs the four key columns; amounts need price and discount
    assert cols == ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount"]


def test_summary_statistics_read_the_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = spark.sparkContext.parallelize([(1, 2.5, "b"), (None, float(3), "a"), (3, None, None)], 2).map(seen)
    got = R.summary_statistics(spark.createDataFrame(rows, "n int, x double, s string")).collect()
    assert read.value == 3
    assert [tuple(r) for r in got if r.summary in ("count", "min", "max")] == [
        ("count", "2", "2", "2"), ("min", "1", "2.5", "a"), ("max", "3", "3.0", "b"),
    ]
