import re

from pyspark.sql import functions as F

from scale_factors import SF01
from ratelens.operators.ranking import distribution_stats, exact_quantiles, ntile_summary, ordered_prefix, value_counts
from ratelens.sources.tables import load_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_children(df):
    """What the default plan gathers into one partition."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [lines[at + 1 : at + 3] for at, line in enumerate(lines) if "Exchange SinglePartition" in line]


def test_default_ranking_plans_gather_no_values(spark):
    """One partition only above aggregates (counts, partition totals), never for values; no sort of a column in one task."""
    li = load_table(spark, SF01, "lineitem")
    vc = value_counts(li, [], "l_extendedprice")
    frames = [
        ntile_summary(li, "l_extendedprice", 10),
        exact_quantiles(li, "l_extendedprice", [0.5]),
        distribution_stats(li, "l_extendedprice", [0.25, 0.5]),
        ordered_prefix(vc, [], "l_extendedprice", ["n"]),
    ]
    for df in frames:
        df.collect()
        for below in _single_partition_children(df):
            assert any("Aggregate" in x for x in below), below
        assert re.search(r"\bntile\(", _plan(df)) is None


def test_prefix_reaches_the_total_past_a_hot_value(spark):
    li = load_table(spark, SF01, "lineitem").withColumn("v", F.when(F.col("l_linenumber") < 3, 5.0).otherwise(F.col("l_extendedprice")))
    pre = ordered_prefix(value_counts(li, [], "v"), [], "v", ["n"], partitions=8)
    rows = pre.orderBy("v").collect()
    assert len(rows) == li.select("v").distinct().count() and rows[-1]["cum_n"] == rows[0]["tot_n"] == li.count()
    assert [r["next_value"] for r in rows] == [r["v"] for r in rows[1:]] + [None]


def test_month_filter_is_pushed_down(spark):
    li = load_table(spark, SF01, "lineitem")
    start = F.lit("1997-04-01").cast("timestamp_ntz")
    p = _plan(li.where((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < F.add_months(start, 1).cast("timestamp_ntz"))).select("l_extendedprice"))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in p
