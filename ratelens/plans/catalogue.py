"""Named queries over the test tables, each with its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Oracle SQL runs against the star-schema views; the policy table is inlined
as a CTE.  Statistics computed with floating-point accumulation (stddev,
averages of ratios, interpolated percentiles) are rounded to 6 decimals on
both sides, since their last bits depend on summation order; totals use
exact decimal sums on both sides and are compared unrounded.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.plans import reports as R
from ratelens.sources.policy import POLICY_SQL, policy_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6
AMOUNT_SCALE = 4


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@functools.lru_cache(maxsize=8)
def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy view, built once per session and directory (a lazy plan;
    every report still executes from the tables)."""
    return policy_frame(spark, sf_dir)


def policy_query(name: str, sql: str | None, report, round_cols: tuple[str, ...] = ()):
    """Register ``report(policy)`` with an oracle over the policy CTE.

    Amounts and rates of the policy view carry at most ``AMOUNT_SCALE`` decimals, so sums at that scale are exact.
    """
    if "scale" in inspect.signature(report).parameters:
        report = functools.partial(report, scale=AMOUNT_SCALE)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = report(_policy(spark, sf_dir))
        return _round(out, *round_cols) if round_cols else out

    if sql is not None:
        sql = sql.strip()
        # a query with its own CTEs continues the policy CTE list
        sql = f"WITH policy AS ({POLICY_SQL}),\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH policy AS ({POLICY_SQL})\n{sql}"
    register(name, sql)(q)


def MSUM(c: str) -> str:
    return f"round(fsum({c}), {AMOUNT_SCALE})"


def MAVG(c: str) -> str:
    return f"{MSUM(c)} / nullif(count({c}), 0)"


def R6(e: str) -> str:
    return f"round({e}, {DIGITS})"


TRIPLE = f"count(rec_id) AS policy_count, {MSUM('tot_wprm_amt')} AS total_premium, {MAVG('tot_wprm_amt')} AS avg_premium"

# ------------------------------------------------------------------ exploration
policy_query("a01_schema", None, R.schema_rows)
policy_query("a02_summary_statistics", None, R.summary_statistics)
policy_query(
    "a03_policies_by_state",
    "SELECT acct_st_cd, count(*) AS count FROM policy GROUP BY acct_st_cd",
    R.policies_by_state,
)
policy_query(
    "a04_unique_accounts",
    "SELECT count(DISTINCT acct_nm) + max(CASE WHEN acct_nm IS NULL THEN 1 ELSE 0 END) AS unique_accounts FROM policy",
    R.unique_accounts,
)
policy_query(
    "a05_unique_policies",
    "SELECT count(DISTINCT pol_nbr) + max(CASE WHEN pol_nbr IS NULL THEN 1 ELSE 0 END) AS unique_policies FROM policy",
    R.unique_policies,
)
policy_query(
    "a06_policies_by_year_month",
    "SELECT CAST(year(pol_eff_dt) AS INTEGER) AS eff_year, CAST(month(pol_eff_dt) AS INTEGER) AS eff_month, "
    "count(*) AS count FROM policy GROUP BY 1, 2",
    R.policies_by_year_month,
)
policy_query(
    "a07_policy_duration_stats",
    f"""SELECT min(d) AS min_days, max(d) AS max_days, avg(d) AS avg_days,
       {R6('quantile_cont(d, 0.5)')} AS median_days
FROM (SELECT CAST(date_diff('day', CAST(pol_eff_dt AS DATE), CAST(pol_expir_dt AS DATE)) AS INTEGER) AS d FROM policy)""",
    R.policy_duration_stats,
    ("median_days",),
)
policy_query(
    "a08_with_effective_date",
    "SELECT *, CAST(year(pol_eff_dt) AS INTEGER) AS eff_year, CAST(month(pol_eff_dt) AS INTEGER) AS eff_month FROM policy",
    R.with_effective_date,
)
# ------------------------------------------------------------------ premium
policy_query(
    "a09_premium_by_form",
    f"SELECT pol_fm_cd, count(rec_id) AS policy_count, {MAVG('tot_wprm_amt')} AS avg_written_premium, "
    f"{MSUM('tot_wprm_amt')} AS total_written_premium FROM policy GROUP BY pol_fm_cd",
    R.premium_by_form,
)
policy_query(
    "a10_premium_distribution_stats",
    f"""SELECT min(tot_wprm_amt) AS min_premium,
       {R6('quantile_cont(tot_wprm_amt, 0.25)')} AS "25th_percentile",
       {R6('quantile_cont(tot_wprm_amt, 0.5)')} AS median_premium,
       {R6('quantile_cont(tot_wprm_amt, 0.75)')} AS "75th_percentile",
       max(tot_wprm_amt) AS max_premium, {MAVG('tot_wprm_amt')} AS avg_premium,
       {R6('stddev_samp(tot_wprm_amt)')} AS stddev_premium
FROM policy""",
    R.premium_distribution_stats,
    ("25th_percentile", "median_premium", "75th_percentile", "stddev_premium"),
)
policy_query(
    "a11_state_earned_premium",
    f"SELECT acct_st_cd, count(rec_id) AS policy_count, {MSUM('cy_yr1_ep_amt')} AS total_earned_premium, "
    f"{MAVG('cy_yr1_ep_amt')} AS avg_earned_premium FROM policy GROUP BY acct_st_cd",
    R.state_earned_premium,
)
policy_query(
    "a12_top_cities",
    f"SELECT acct_st_cd, cty_nm, {MSUM('tot_wprm_amt')} AS total_premium, count(rec_id) AS policy_count "
    "FROM policy GROUP BY acct_st_cd, cty_nm "
    "ORDER BY total_premium DESC NULLS LAST, acct_st_cd ASC NULLS FIRST, cty_nm ASC NULLS FIRST LIMIT 15",
    R.top_cities,
)
_RATIO = "CASE WHEN tot_expos_qty > 0 THEN tot_wprm_amt / tot_expos_qty END"
policy_query(
    "a13_state_exposure_ratio",
    f"SELECT acct_st_cd, {R6(f'avg({_RATIO})')} AS avg_premium_per_exposure, "
    f"{R6(f'stddev_samp({_RATIO})')} AS stddev_premium_per_exposure FROM policy GROUP BY acct_st_cd",
    R.state_exposure_ratio,
    ("avg_premium_per_exposure", "stddev_premium_per_exposure"),
)
policy_query(
    "a14_form_exposure",
    f"SELECT pol_fm_cd, {MSUM('tot_expos_qty')} AS total_exposure, {R6(f'avg({_RATIO})')} AS avg_premium_per_exposure, "
    "count(rec_id) AS policy_count FROM policy GROUP BY pol_fm_cd",
    R.form_exposure,
    ("avg_premium_per_exposure",),
)
policy_query(
    "a15_quarterly_trends",
    f"SELECT CAST(year(pol_eff_dt) AS INTEGER) AS eff_year, CAST(quarter(pol_eff_dt) AS INTEGER) AS eff_quarter, "
    f"{MSUM('tot_wprm_amt')} AS total_written_premium, {MAVG('tot_wprm_amt')} AS avg_written_premium, "
    "count(rec_id) AS policy_count FROM policy GROUP BY 1, 2",
    R.quarterly_trends,
)
policy_query(
    "a16_industry_by_name",
    f"SELECT indus_grp_nm, count(rec_id) AS policy_count, {MSUM('tot_wprm_amt')} AS total_written_premium, "
    f"{MAVG('tot_wprm_amt')} AS avg_written_premium FROM policy GROUP BY indus_grp_nm",
    R.industry_by_name,
)
policy_query(
    "a17_industry_by_code",
    f"SELECT indus_grp_cd, {TRIPLE} FROM policy GROUP BY indus_grp_cd",
    R.industry_by_code,
)
policy_query(
    "a18_premium_deciles",
    f"""SELECT premium_decile, min(tot_wprm_amt) AS min_premium, max(tot_wprm_amt) AS max_premium,
       {MAVG('tot_wprm_amt')} AS avg_premium, count(rec_id) AS policy_count
FROM (SELECT tot_wprm_amt, rec_id, CAST(ntile(10) OVER (ORDER BY tot_wprm_amt, rec_id IS NULL) AS INTEGER) AS premium_decile
      FROM policy WHERE tot_wprm_amt IS NOT NULL)
GROUP BY premium_decile""",
    R.premium_deciles,
)
# ------------------------------------------------------------------ commission
policy_query(
    "a19_state_commission",
    f"SELECT acct_st_cd, {MAVG('comm_pct')} AS avg_commission_pct, "
    f"{R6('avg(comm_amt / nullif(tot_wprm_amt, 0))')} AS avg_comm_to_premium_ratio, "
    f"{MSUM('comm_amt')} AS total_commission FROM policy GROUP BY acct_st_cd",
    R.state_commission,
    ("avg_comm_to_premium_ratio",),
)
policy_query(
    "a20_form_commission",
    f"SELECT pol_fm_cd, {MAVG('comm_pct')} AS avg_commission_pct, {MSUM('comm_amt')} AS total_commission, "
    "count(*) AS policy_count FROM policy GROUP BY pol_fm_cd",
    R.form_commission,
)
policy_query(
    "a21_waived_commission_by_state",
    f"SELECT acct_st_cd, {MSUM('waiv_comm_amt')} AS total_waived_commission, count(*) AS policies_with_waived_comm "
    "FROM policy WHERE waiv_comm_amt > 0 GROUP BY acct_st_cd",
    R.waived_commission_by_state,
)
# ------------------------------------------------------------------ growth
_YOY = "CASE WHEN cy_yr2_wprm_amt > 0 THEN (cy_yr1_wprm_amt - cy_yr2_wprm_amt) / cy_yr2_wprm_amt * 100 END"
policy_query(
    "a22_yoy_growth",
    f"SELECT rec_id, cy_yr1_wprm_amt, cy_yr2_wprm_amt, {_YOY} AS yoy_growth_pct FROM policy",
    R.yoy_growth,
)
policy_query(
    "a23_growth_buckets",
    f"""SELECT CASE WHEN g < -10 THEN 'Significant Decrease'
            WHEN g BETWEEN -10 AND -0.01 THEN 'Moderate Decrease'
            WHEN g BETWEEN 0 AND 10 THEN 'Moderate Increase'
            WHEN g > 10 THEN 'Significant Increase'
            ELSE 'No Change' END AS growth_bucket, count(*) AS count
FROM (SELECT {_YOY} AS g FROM policy) GROUP BY 1""",
    R.growth_buckets,
)
# ------------------------------------------------------------------ location / coverage
_LOC = (
    f"SELECT loc_nbr, count(rec_id) AS policy_count, {MAVG('bas_rt')} AS avg_base_rate, "
    f"{MSUM('tot_wprm_amt')} AS total_premium FROM policy GROUP BY loc_nbr"
)
policy_query("a24_location_risk", _LOC, R.location_risk)
policy_query(
    "a24_location_risk_top10",
    _LOC + " ORDER BY total_premium DESC NULLS LAST, loc_nbr ASC NULLS FIRST LIMIT 10",
    functools.partial(R.location_risk, top=10),
)
policy_query(
    "a25_coverage_pivot",
    "SELECT pol_fm_cd, "
    + ", ".join(f"count(CASE WHEN cov_splt_typ_cd = '{v}' THEN rec_id END) AS \"{v}\"" for v in ("A", "N", "R"))
    + " FROM policy GROUP BY pol_fm_cd",
    R.coverage_pivot,
)
# ------------------------------------------------------------------ quarterly patterns
_Q = [f"cy_qtr{i}_wprm_amt" for i in range(1, 9)]
_PCT = ", ".join(f"CASE WHEN cy_yr1_wprm_amt > 0 THEN ({q} / cy_yr1_wprm_amt) * 100 END AS {q}_pct" for q in _Q)
_VAR = ", ".join(
    f"abs(({_Q[i + 1]} - {_Q[i]}) / CASE WHEN {_Q[i]} > 0 THEN {_Q[i]} ELSE 1 END) * 100 AS variation_{i + 1}_to_{i + 2}"
    for i in range(7)
)
policy_query(
    "a26_quarterly_pattern",
    f"SELECT rec_id, {', '.join(_Q)}, cy_yr1_wprm_amt, cy_yr2_wprm_amt, {_PCT} FROM policy",
    R.quarterly_pattern,
)
policy_query(
    "a27_avg_quarterly_pattern",
    "SELECT "
    + ", ".join(
        R6(f"avg(CASE WHEN cy_yr1_wprm_amt > 0 THEN ({q} / cy_yr1_wprm_amt) * 100 END)") + f" AS avg_{q}_pct" for q in _Q
    )
    + " FROM policy",
    R.avg_quarterly_pattern,
    tuple(f"avg_{q}_pct" for q in _Q),
)
policy_query(
    "a28_quarterly_variation",
    f"SELECT rec_id, {', '.join(_Q)}, cy_yr1_wprm_amt, cy_yr2_wprm_amt, {_PCT}, {_VAR} FROM policy",
    R.quarterly_variation,
)
policy_query(
    "a29_high_variation_policies",
    f"""SELECT * FROM (SELECT rec_id, {', '.join(_Q)}, {_VAR} FROM policy)
WHERE {' OR '.join(f'variation_{i}_to_{i + 1} > 25' for i in range(1, 8))}
ORDER BY variation_1_to_2 DESC NULLS LAST, rec_id ASC NULLS FIRST LIMIT 10""",
    R.high_variation_policies,
)
# ------------------------------------------------------------------ vehicles
_VEH = "(SELECT *, split_part(veh_mk_mdl_nm_leg, ' ', 1) AS vehicle_make FROM policy WHERE vin IS NOT NULL)"
policy_query("a30_vehicle_policies", f"SELECT * FROM {_VEH}", R.vehicle_policies)
policy_query(
    "a31_premium_by_vehicle_make",
    f"SELECT vehicle_make, {TRIPLE} FROM {_VEH} GROUP BY vehicle_make "
    "ORDER BY policy_count DESC NULLS LAST, vehicle_make ASC NULLS FIRST LIMIT 15",
    R.premium_by_vehicle_make,
)
policy_query(
    "a32_premium_by_vehicle_class",
    f"SELECT veh_cls_hgh_lvl_desc, {TRIPLE} FROM {_VEH} GROUP BY veh_cls_hgh_lvl_desc "
    "ORDER BY total_premium DESC NULLS LAST, veh_cls_hgh_lvl_desc ASC NULLS FIRST LIMIT 10",
    R.premium_by_vehicle_class,
)
policy_query(
    "a33_premium_by_vehicle_group",
    f"SELECT veh_grp_typ_cd, {TRIPLE} FROM {_VEH} GROUP BY veh_grp_typ_cd "
    "ORDER BY policy_count DESC NULLS LAST, veh_grp_typ_cd ASC NULLS FIRST LIMIT 10",
    R.premium_by_vehicle_group,
)
# ------------------------------------------------------------------ risk factors
policy_query(
    "a34_premium_by_hazard",
    f"SELECT haz_cd_leg, {TRIPLE}, {MAVG('bas_rt')} AS avg_base_rate FROM policy WHERE haz_cd_leg IS NOT NULL "
    "GROUP BY haz_cd_leg ORDER BY policy_count DESC NULLS LAST, haz_cd_leg ASC NULLS FIRST LIMIT 10",
    R.premium_by_hazard,
)
policy_query(
    "a35_rate_bands",
    f"""WITH rated AS (SELECT * FROM policy WHERE bas_rt IS NOT NULL),
q AS (SELECT quantile_cont(bas_rt, [0.2, 0.4, 0.6, 0.8]) AS p FROM rated)
SELECT rate_band, count(rec_id) AS policy_count, {MAVG('bas_rt')} AS avg_base_rate,
       {MAVG('tot_wprm_amt')} AS avg_premium, {MSUM('tot_wprm_amt')} AS total_premium
FROM (SELECT CASE WHEN bas_rt <= p[1] THEN 'Very Low' WHEN bas_rt <= p[2] THEN 'Low'
                  WHEN bas_rt <= p[3] THEN 'Medium' WHEN bas_rt <= p[4] THEN 'High' ELSE 'Very High' END AS rate_band,
             rec_id, bas_rt, tot_wprm_amt FROM rated, q)
GROUP BY rate_band""",
    R.rate_bands,
)
policy_query(
    "a36_premium_by_product",
    f"SELECT rtmk_prdct_cd_leg, {TRIPLE} FROM policy GROUP BY rtmk_prdct_cd_leg "
    "ORDER BY policy_count DESC NULLS LAST, rtmk_prdct_cd_leg ASC NULLS FIRST LIMIT 10",
    R.premium_by_product,
)
policy_query(
    "a37_premium_by_premium_type",
    f"SELECT prem_typ_cd, {TRIPLE} FROM policy GROUP BY prem_typ_cd",
    R.premium_by_premium_type,
)
policy_query(
    "a38_risk_columns",
    "SELECT rec_id, haz_cd_leg, bas_rt, rtmk_prdct_cd_leg, prem_typ_cd, tot_wprm_amt FROM policy",
    R.risk_columns,
)
# ------------------------------------------------------------------ renewals
policy_query(
    "a39_premium_by_renewal_status",
    f"SELECT new_ren_cd, {TRIPLE} FROM policy GROUP BY new_ren_cd",
    R.premium_by_renewal_status,
)
_REN = """SELECT acct_st_cd, "N", "R", "R" / ("R" + "N") * 100 AS renewal_rate FROM (
  SELECT acct_st_cd, CAST(sum(CASE WHEN new_ren_cd = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS "N",
         CAST(sum(CASE WHEN new_ren_cd = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS "R"
  FROM policy GROUP BY acct_st_cd)"""
policy_query("a40_renewal_by_state", _REN, R.renewal_by_state)
policy_query(
    "a40_top_renewal_states",
    _REN + " ORDER BY renewal_rate DESC NULLS LAST, acct_st_cd ASC NULLS FIRST LIMIT 10",
    R.top_renewal_states,
)
policy_query(
    "a41_premium_by_status_and_form",
    f"SELECT new_ren_cd, pol_fm_cd, {TRIPLE} FROM policy GROUP BY new_ren_cd, pol_fm_cd "
    "ORDER BY new_ren_cd ASC NULLS FIRST, policy_count DESC NULLS LAST, pol_fm_cd ASC NULLS FIRST LIMIT 15",
    R.premium_by_status_and_form,
)
# ------------------------------------------------------------------ earned premium
_EP = "CASE WHEN tot_wprm_amt > 0 THEN cy_yr1_ep_amt / tot_wprm_amt END"
policy_query("a42_earned_ratio_rows", f"SELECT *, {_EP} AS ep_wp_ratio FROM policy", R.earned_ratio_rows)
policy_query(
    "a43_earned_ratio_stats",
    f"SELECT {R6(f'avg({_EP})')} AS avg_ratio, min({_EP}) AS min_ratio, max({_EP}) AS max_ratio, "
    f"{R6(f'stddev_samp({_EP})')} AS stddev_ratio FROM policy",
    R.earned_ratio_stats,
    ("avg_ratio", "stddev_ratio"),
)
for _key, _fn, _name in (
    ("acct_st_cd", R.earned_ratio_by_state, "a44_earned_ratio_by_state"),
    ("pol_fm_cd", R.earned_ratio_by_form, "a45_earned_ratio_by_form"),
):
    policy_query(
        _name,
        f"SELECT {_key}, {R6(f'avg({_EP})')} AS avg_ratio, {MSUM('cy_yr1_ep_amt')} AS total_earned_premium, "
        f"{MSUM('tot_wprm_amt')} AS total_written_premium, count(rec_id) AS policy_count FROM policy "
        f"GROUP BY {_key} ORDER BY policy_count DESC NULLS LAST, {_key} ASC NULLS FIRST LIMIT 10",
        _fn,
        ("avg_ratio",),
    )


# ====================================================================== part B
from ratelens.operators import colocate as C  # noqa: E402
from ratelens.sources.snapshots import SnapshotStore  # noqa: E402
from ratelens.sources.tables import load_table  # noqa: E402

# Fixed value: explicit splits for the oracle-checked bucket reports.
EXPLICIT_SPLITS = [float("-inf"), 300.0, 600.0, 900.0, 1200.0, float("inf")]


def _bucket_case(col: str) -> str:
    inner = EXPLICIT_SPLITS[1:-1]
    whens = " ".join(f"WHEN {col} < {s} THEN {i}" for i, s in enumerate(inner))
    return f"CAST(CASE {whens} ELSE {len(inner)} END AS INTEGER)"


def _copart(spark: SparkSession, sf_dir: str, splits=None) -> C.CoPartitioned:
    cust = load_table(spark, sf_dir, "customer")
    details = [
        (load_table(spark, sf_dir, "orders"), "o_custkey"),
        (load_table(spark, sf_dir, "events"), "user_id"),
        (load_table(spark, sf_dir, "nation"), "nationkey"),  # wrong key name: skipped
    ]
    return C.plan_copartitioned(cust, "c_custkey", details, 10, splits=splits)


@register("b03_master_buckets_learned")
def _b03(spark, sf_dir):
    """Bucket report of the master under splits learnt from its key (approximate, rows-only check)."""
    p = _copart(spark, sf_dir)
    return C.bucket_report(p.frames["master"], "c_custkey")


register(
    "b04_master_buckets_explicit",
    f"SELECT {_bucket_case('c_custkey')} AS partition_key, count(*) AS row_count, min(c_custkey) AS min_key, "
    "max(c_custkey) AS max_key FROM customer GROUP BY 1",
)(lambda spark, sf_dir: C.bucket_report(_copart(spark, sf_dir, EXPLICIT_SPLITS).frames["master"], "c_custkey"))
register(
    "b04_detail_buckets_explicit",
    f"SELECT {_bucket_case('o_custkey')} AS partition_key, count(*) AS row_count, min(o_custkey) AS min_key, "
    "max(o_custkey) AS max_key FROM orders GROUP BY 1",
)(lambda spark, sf_dir: C.bucket_report(_copart(spark, sf_dir, EXPLICIT_SPLITS).frames["detail_0"], "o_custkey"))


@register(
    "b08_copartitioned_join",
    f"SELECT c.*, {_bucket_case('c.c_custkey')} AS partition_key, o.o_orderkey, o.o_totalprice "
    "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
)
def _b08(spark, sf_dir):
    p = _copart(spark, sf_dir, EXPLICIT_SPLITS)
    return C.join_copartitioned(p.frames["master"], p.frames["detail_0"], "c_custkey", "o_custkey", detail_columns=["o_orderkey", "o_totalprice"])


@register(
    "b08_copartitioned_join_events",
    f"SELECT c.*, {_bucket_case('c.c_custkey')} AS partition_key, e.event_id, e.event_type, e.value "
    "FROM customer c JOIN events e ON c.c_custkey = e.user_id",
)
def _b08e(spark, sf_dir):
    p = _copart(spark, sf_dir, EXPLICIT_SPLITS)
    return C.join_copartitioned(p.frames["master"], p.frames["detail_1"], "c_custkey", "user_id", detail_columns=["event_id", "event_type", "value"])


# ====================================================================== part C
from ratelens.functions.lineage import shared_path  # noqa: E402
from ratelens.operators.alerts import Rule, alerts  # noqa: E402
from ratelens.operators.heavy_join import join_heavy  # noqa: E402
from ratelens.operators.sample import exact_sample  # noqa: E402
from ratelens.plans import drift_sql as DS  # noqa: E402
from ratelens.plans import monitor as M  # noqa: E402

DRIFT_ROUND = ("ks_p_value", "wasserstein_distance", "wasserstein_norm", "js_divergence")
PROFILE_ROUND = ("stddev", "p25", "p50", "p75")
LI_NUM = ["l_extendedprice", "l_quantity", "l_discount"]
LI_CAT = ["l_returnflag", "l_linestatus"]
LI_SLICES = ["l_returnflag = 'R'", "l_linestatus = 'O'"]
# The alert rules of the alert queries.
RULES = [
    Rule("wasserstein_over_0_05", "wasserstein_distance", "wasserstein_distance > 0.05"),
    Rule("ks_p_below_0_05", "ks_p_value", "ks_p_value < 0.05"),
    Rule("jsd_over_0_01", "js_divergence", "js_divergence > 0.01"),
]


def _li(spark, sf_dir):
    return load_table(spark, sf_dir, "lineitem")


register(
    "d01_drift_time_series_lineitem", DS.drift_time_series_sql("lineitem", "l_shipdate", LI_NUM, LI_CAT)
)(lambda spark, sf_dir: _round(M.drift_time_series(_li(spark, sf_dir), "l_shipdate", LI_NUM + LI_CAT, mean_scale=4), *DRIFT_ROUND))

register(
    "d01_drift_time_series_orders",
    DS.drift_time_series_sql("orders", "o_orderdate", ["o_totalprice"], ["o_orderpriority", "o_orderstatus"]),
)(
    lambda spark, sf_dir: _round(
        M.drift_time_series(load_table(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice", "o_orderpriority", "o_orderstatus"], mean_scale=4),
        *DRIFT_ROUND,
    )
)

register(
    "d07_drift_all_columns_orders",
    DS.drift_time_series_sql(
        "orders", "o_orderdate", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
    ),
)(lambda spark, sf_dir: _round(M.drift_time_series(load_table(spark, sf_dir, "orders"), "o_orderdate", mean_scale=4), *DRIFT_ROUND))

register(
    "d17_drift_sliced_lineitem",
    DS.drift_time_series_sql("lineitem", "l_shipdate", ["l_extendedprice", "l_discount"], ["l_returnflag"], LI_SLICES),
)(
    lambda spark, sf_dir: _round(
        M.drift_time_series(_li(spark, sf_dir), "l_shipdate", ["l_extendedprice", "l_discount", "l_returnflag"], LI_SLICES, mean_scale=4),
        *DRIFT_ROUND,
    )
)

register(
    "d17_drift_by_group_lineitem",
    DS.drift_time_series_sql("lineitem", "l_shipdate", ["l_extendedprice"], ["l_linestatus"], groups=["l_returnflag"]),
)(
    lambda spark, sf_dir: _round(
        M.drift_time_series(_li(spark, sf_dir), "l_shipdate", ["l_extendedprice", "l_linestatus"], group_cols=["l_returnflag"], mean_scale=4),
        *DRIFT_ROUND,
    )
)

register("d08_profile_lineitem", DS.profile_sql("lineitem", "l_shipdate", LI_NUM, LI_CAT, LI_SLICES[:1]))(
    lambda spark, sf_dir: _round(M.profile(_li(spark, sf_dir), "l_shipdate", LI_NUM + LI_CAT, LI_SLICES[:1], mean_scale=4), *PROFILE_ROUND)
)


register(
    "d08_profile_by_group_orders",
    DS.profile_sql("orders", "o_orderdate", ["o_totalprice"], ["o_orderpriority"], groups=["o_orderstatus"]),
)(
    lambda spark, sf_dir: _round(
        M.profile(load_table(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice", "o_orderpriority"], group_cols=["o_orderstatus"], mean_scale=4),
        *PROFILE_ROUND,
    )
)


def _month_range(df: DataFrame, ts: str) -> list[tuple[int, int]]:
    """Calendar months between the first and the last timestamp (one-row aggregate)."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    out, (y, m) = [], (lo.year, lo.month)
    while (y, m) <= (hi.year, hi.month):
        out.append((y, m))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


@register(
    "d03_drift_separate_monthly_tables",
    DS.drift_time_series_sql("lineitem", "l_shipdate", ["l_extendedprice"], ["l_returnflag"]),
)
def _d03(spark, sf_dir):
    li = _li(spark, sf_dir)
    # the monthly tables, written in one pass: a resolved month is read from its own files
    path = shared_path(spark, "monthly")
    tables = li.select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start"), "l_extendedprice", "l_returnflag")
    tables.where("month_start IS NOT NULL").write.partitionBy("month_start").parquet(path)
    tables = spark.read.schema(tables.schema).parquet(path)

    def resolve(y: int, m: int) -> DataFrame:  # the month's "separate table"
        return tables.where(F.col("month_start") == F.make_date(F.lit(y), F.lit(m), F.lit(1))).drop("month_start")

    out = M.drift_separate(resolve, _month_range(li, "l_shipdate"), ["l_extendedprice", "l_returnflag"], mean_scale=4)
    return _round(out, *DRIFT_ROUND)


@register(
    "d02_drift_snapshot_month",
    "SELECT * FROM ("
    + DS.drift_time_series_sql("lineitem", "l_shipdate", LI_NUM, LI_CAT, ["l_returnflag = 'R'"])
    + ") WHERE window_start = DATE '1997-04-01'",
)
def _d02(spark, sf_dir):
    """1997-04 partition against the 1997-03 baseline, whole and one slice."""
    li = _li(spark, sf_dir).withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
    cur = li.where((F.col("year") == 1997) & (F.col("month") == 4))
    base = li.where((F.col("year") == 1997) & (F.col("month") == 3))
    out = M.drift_snapshot(cur, base, LI_NUM + LI_CAT, ["l_returnflag = 'R'"], "1997-04-01", "1997-03-01", mean_scale=4)
    return _round(out, *DRIFT_ROUND)


def _alerts_sql(drift_sql: str) -> str:
    parts = [
        f"SELECT '{r.name}' AS rule, window_start, baseline_start, slice, column_name, CAST({r.metric} AS DOUBLE) AS metric_value "
        f"FROM ({drift_sql}) d WHERE {r.condition}"
        for r in RULES
    ]
    return "\nUNION ALL\n".join(parts)


register("d16_alerts_lineitem", _alerts_sql(DS.drift_time_series_sql("lineitem", "l_shipdate", LI_NUM, LI_CAT)))(
    lambda spark, sf_dir: alerts(
        _round(M.drift_time_series(_li(spark, sf_dir), "l_shipdate", LI_NUM + LI_CAT, mean_scale=4), *DRIFT_ROUND), RULES
    )
)

# User metrics as SQL aggregates (exact decimal sums, so window values are
# reproducible bit for bit).
CUSTOM = {
    "avg_discount": "CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(l_discount)",
    "revenue": "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)",
    "rows": "count(*)",
}


@register(
    "d15_custom_metric_drift",
    f"""WITH cm AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS window_start, 'all' AS slice,
         {CUSTOM['avg_discount']} AS avg_discount, {CUSTOM['revenue']} AS revenue, CAST(count(*) AS DOUBLE) AS "rows"
  FROM lineitem GROUP BY 1),
lg AS (UNPIVOT cm ON avg_discount, revenue, "rows" INTO NAME metric_name VALUE metric_value)
SELECT c.window_start, CAST(c.window_start - INTERVAL 1 MONTH AS DATE) AS baseline_start, c.slice, c.metric_name,
       p.metric_value AS baseline_value, c.metric_value AS current_value, c.metric_value - p.metric_value AS delta
FROM lg c LEFT JOIN lg p ON p.window_start = CAST(c.window_start - INTERVAL 1 MONTH AS DATE)
  AND p.slice = c.slice AND p.metric_name = c.metric_name""",
)
def _d15(spark, sf_dir):
    return M.custom_metric_drift(_li(spark, sf_dir), "l_shipdate", CUSTOM)


@register("d18_drift_on_hash_sample")
def _d18(spark, sf_dir):
    """Drift on a deterministic half sample of the rows (rows-only check: the
    sample hash is Spark's xxhash64)."""
    sample = M.hash_sample(_li(spark, sf_dir), ["l_orderkey", "l_linenumber"], 0.5)
    return _round(M.drift_time_series(sample, "l_shipdate", LI_NUM + LI_CAT, mean_scale=4), *DRIFT_ROUND)


SAMPLE_ROWS, SAMPLE_SEED = 20_000, 42
_SAMPLE_SQL = (
    f"(SELECT * FROM lineitem ORDER BY ('0x' || md5('{SAMPLE_SEED}|=' || l_orderkey || '|=' || l_linenumber)[1:15])::BIGINT "
    f"LIMIT {SAMPLE_ROWS}) AS sampled"
)


@register("d18_drift_on_exact_sample", DS.drift_time_series_sql(_SAMPLE_SQL, "l_shipdate", LI_NUM, LI_CAT))
def _d18_exact(spark, sf_dir):
    """Drift on 20,000 rows drawn by a seeded hash of the key."""
    sample = exact_sample(_li(spark, sf_dir), ["l_orderkey", "l_linenumber"], SAMPLE_ROWS, SAMPLE_SEED)
    return _round(M.drift_time_series(sample, "l_shipdate", LI_NUM + LI_CAT, mean_scale=4), *DRIFT_ROUND)


@register(
    "d19_critical_vs_all",
    f"""WITH d AS ({DS.drift_time_series_sql("lineitem", "l_shipdate", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])}),
f AS (SELECT DISTINCT window_start, column_name, 1 AS drifted FROM d WHERE wasserstein_distance > 0.05)
SELECT d.window_start, count(*) AS columns_all, sum(coalesce(f.drifted, 0)) AS drifted_all,
       sum(CASE WHEN d.column_name IN ('l_extendedprice', 'l_discount') THEN 1 ELSE 0 END) AS columns_critical,
       sum(CASE WHEN d.column_name IN ('l_extendedprice', 'l_discount') THEN coalesce(f.drifted, 0) ELSE 0 END) AS drifted_critical
FROM d LEFT JOIN f USING (window_start, column_name) WHERE d.slice = 'all' GROUP BY d.window_start""",
)
def _d19(spark, sf_dir):
    return M.critical_vs_all(_li(spark, sf_dir), "l_shipdate", ["l_extendedprice", "l_discount"], mean_scale=4)


# ---------------------------------------------------------------- wide and incremental monitors

from ratelens.plans import wide_monitor as W  # noqa: E402

SKETCH_ROUND = ("null_rate_delta", "mean_drift", "ks_stat", *DRIFT_ROUND, "ks_error", "wasserstein_error")
#: 104 columns: each number of a line item at thirteen price levels.
WIDE_BASE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE = {f"{c[2:]}_{i:02d}": f"CAST({c} AS DOUBLE) * CAST({1 + i / 8!r} AS DOUBLE)" for c in WIDE_BASE for i in range(13)}
WIDE_TABLE = (
    "(SELECT l_shipdate, l_returnflag, "
    + ", ".join(f"{e} AS {n}" for n, e in WIDE.items())
    + " FROM lineitem) w"
)
FIRST_MONTH = "1995-01-01"


def _in_month(df: DataFrame, ts: str, first: str) -> DataFrame:
    """One month's rows by a range of the timestamp, which reaches the Parquet scan."""
    start = F.lit(first).cast("timestamp_ntz")
    return df.where((F.col(ts) >= start) & (F.col(ts) < F.add_months(start, 1).cast("timestamp_ntz")))


@register(
    "d07_wide_drift_sketched",
    DS.sketch_drift_sql(WIDE_TABLE, "l_shipdate", list(WIDE), ["l_returnflag"], [], FIRST_MONTH, 17),
)
def _d07_wide(spark, sf_dir):
    """Month-over-month drift of 104 columns by sketches over the first month's grid."""
    wide = _li(spark, sf_dir).select("l_shipdate", "l_returnflag", *[F.expr(e).alias(n) for n, e in WIDE.items()])
    columns = [*WIDE, "l_returnflag"]
    grid = W.make_grid(_in_month(wide, "l_shipdate", FIRST_MONTH), columns, points=17)
    return _round(W.drift_sketched(wide, "l_shipdate", grid), *SKETCH_ROUND)


@register(
    "d04_incremental_sketch_store",
    "SELECT * FROM ("
    + DS.sketch_drift_sql("lineitem", "l_shipdate", LI_NUM, LI_CAT, LI_SLICES, FIRST_MONTH, 32)
    + ") WHERE window_start IN (DATE '1997-03-01', DATE '1997-04-01', DATE '1997-05-01')",
)
def _d04(spark, sf_dir):
    """Months sketched one at a time into a store, each compared with its stored predecessor."""
    li = _li(spark, sf_dir)
    grid = W.make_grid(_in_month(li, "l_shipdate", FIRST_MONTH), LI_NUM + LI_CAT, points=32)
    store = W.SketchStore.create(spark, shared_path(spark, "sketches"), grid, LI_SLICES)
    for m in (2, 3, 4, 5):
        store.append(_in_month(li, "l_shipdate", f"1997-{m:02d}-01"), 1997, m)
    out = functools.reduce(DataFrame.unionByName, [store.drift(1997, m) for m in (3, 4, 5)])
    return _round(out, *SKETCH_ROUND)


# ---------------------------------------------------------------- written layouts and snapshots

_B08_SQL = (
    f"SELECT c.*, {_bucket_case('c.c_custkey')} AS partition_key, o.o_orderkey, o.o_totalprice "
    "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"
)


@register("b07_write_read_join_partitioned", _B08_SQL)
def _b07(spark, sf_dir):
    """Master and details written by bucket, read back from their paths and joined."""
    p = C.write_copartitioned(_copart(spark, sf_dir, EXPLICIT_SPLITS), shared_path(spark, "copart"))
    master, orders = (spark.read.parquet(p.paths[k]) for k in ("master", "detail_0"))
    return C.join_copartitioned(master, orders, "c_custkey", "o_custkey", detail_columns=["o_orderkey", "o_totalprice"])


@register("b08_join_bucketed_tables", _B08_SQL)
def _b08_bucketed(spark, sf_dir):
    """Master and details saved as bucketed tables, joined on their keys without a shuffle."""
    path = shared_path(spark, "copart")
    prefix = path.rsplit("/", 1)[-1].replace("-", "_")
    C.write_copartitioned(_copart(spark, sf_dir, EXPLICIT_SPLITS), path, layout="bucketed", table_prefix=prefix)
    orders = spark.table(f"{prefix}_detail_0").select("o_custkey", "o_orderkey", "o_totalprice")
    master = spark.table(f"{prefix}_master")
    return master.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(*master.columns, "o_orderkey", "o_totalprice")


_HOT_KEY = "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END"


@register(
    "j02_heavy_key_join_stored",
    f"SELECT c.*, o.o_orderkey, o.o_totalprice FROM customer c JOIN (SELECT *, {_HOT_KEY} AS hot_key FROM orders) o ON c.c_custkey = o.hot_key",
)
def _j02(spark, sf_dir):
    """Stored, bucketed tables joined on a key of which one value holds a third of the rows."""
    prefix = shared_path(spark, "heavy").rsplit("/", 1)[-1].replace("-", "_")
    orders = load_table(spark, sf_dir, "orders").select(F.expr(_HOT_KEY).alias("hot_key"), "o_orderkey", "o_totalprice")
    for name, df, key in (("master", load_table(spark, sf_dir, "customer"), "c_custkey"), ("detail", orders, "hot_key")):
        C.save_bucketed(df, key, f"{prefix}_{name}", shared_path(spark, f"heavy-{name}"))
    return join_heavy(spark.table(f"{prefix}_master"), spark.table(f"{prefix}_detail"), "c_custkey", "hot_key")


def _captured(spark: SparkSession, sf_dir: str, months: tuple[int, ...]) -> SnapshotStore:
    """A snapshot store with these months of 1997."""
    store = SnapshotStore(spark, shared_path(spark, "snapshots"))
    for m in months:
        store.capture(_in_month(_li(spark, sf_dir), "l_shipdate", f"1997-{m:02d}-01"), 1997, m)
    return store


@register(
    "d05_drift_as_of_snapshot",
    "SELECT * FROM ("
    + DS.drift_time_series_sql("lineitem", "l_shipdate", LI_NUM, LI_CAT, ["l_returnflag = 'R'"])
    + ") WHERE window_start = DATE '1997-04-01'",
)
def _d05(spark, sf_dir):
    """A month against the table as it was at the end of the month before, from captured snapshots."""
    store = _captured(spark, sf_dir, (2, 3, 4))
    out = M.drift_snapshot(
        store.month(1997, 4), store.as_of("1997-04-15"), LI_NUM + LI_CAT, ["l_returnflag = 'R'"], "1997-04-01", "1997-03-01", mean_scale=4
    )
    return _round(out, *DRIFT_ROUND)


@register(
    "s15_snapshot_retention",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS row_count,
  last_day(any_value(l_shipdate)) AS month_end, last_day(any_value(l_shipdate)) < DATE '1997-05-10' - INTERVAL 30 DAY AS expired
FROM lineitem WHERE l_shipdate >= DATE '1997-02-01' AND l_shipdate < DATE '1997-05-01' GROUP BY 1, 2""",
)
def _s15(spark, sf_dir):
    return _captured(spark, sf_dir, (2, 3, 4)).list_snapshots(30, "1997-05-10")
