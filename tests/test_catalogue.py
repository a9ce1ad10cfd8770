import pytest

import __spark_entry__ as E
from scale_factors import SF001
from oracle_check import compare, duck
from ratelens.plans.catalogue import ORACLE, QUERIES

# Queries without an oracle: schema/describe as text, approximate splits,
# xxhash64 sampling.
ROWS_ONLY = {"a01_schema", "a02_summary_statistics", "b03_master_buckets_learned", "d18_drift_on_hash_sample"}


def test_contract(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    df = E.entry(spark)
    assert df.columns == ["acct_st_cd", "policy_count", "total_earned_premium", "avg_earned_premium"]
    assert df.count() > 0


FAST = [
    "a03_policies_by_state", "a07_policy_duration_stats", "a10_premium_distribution_stats", "a18_premium_deciles",
    "a23_growth_buckets", "a25_coverage_pivot", "a29_high_variation_policies", "a35_rate_bands", "a40_renewal_by_state",
    "b04_master_buckets_explicit", "b08_copartitioned_join", "d01_drift_time_series_orders", "d08_profile_lineitem",
    "d15_custom_metric_drift", "d18_drift_on_exact_sample", "j02_heavy_key_join_stored",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_sf0001(spark, con, name):
    r = compare(E.queries()[name](spark, SF001), con, E.oracle_sql()[name])
    assert r["rows_spark"] == r["rows_oracle"] and r["columns_match"] and r["values_match"], r
