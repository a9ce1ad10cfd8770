"""The policy report catalogue (premium, exposure, commission, growth, ...).

Each function takes the wide policy DataFrame and returns a lazy DataFrame;
no function runs a Spark job while building its plan (the only exception is
``pivot`` without explicit values, which - as in Spark itself - runs one
distinct job to learn the pivot columns).  Reports whose optional columns are
missing return ``None``; ``run_all`` lists them under ``skipped``.

Amount totals and averages are plain sums by default; pass ``scale=`` for exact
decimal arithmetic on amounts of at most that many decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.columns import existing_columns, require_columns
from ratelens.functions.expr import (
    any_true,
    first_word,
    label_ladder,
    money_avg,
    money_sum,
    null_inclusive_distinct,
    safe_ratio,
)
from ratelens.operators.pivot import pivot_count, pivot_sum
from ratelens.operators.ranking import distribution_stats, exact_quantiles, ntile_summary
from ratelens.operators.segment import policy_triple, segment_summary

# Column names, thresholds and labels of the reports.
QUARTER_COLUMNS = [f"cy_qtr{i}_wprm_amt" for i in range(1, 9)]
VEHICLE_COLUMNS = ["vin", "veh_mk_mdl_nm_leg", "veh_cls_hgh_lvl_desc", "veh_grp_typ_cd"]
RISK_COLUMNS = ["haz_cd_leg", "bas_rt", "rpt_mnr_ln_cd", "rtmk_prdct_cd_leg", "waiv_rsn_cd_leg", "nprm_cd_inp", "prem_typ_cd"]
PREMIUM_COLUMNS = ["tot_wprm_amt", "cy_yr1_ep_amt", "cy_yr2_ep_amt"]
VARIATION_THRESHOLD = 25
GROWTH_LABELS = ["Significant Decrease", "Moderate Decrease", "Moderate Increase", "Significant Increase", "No Change"]
RATE_BANDS = ["Very Low", "Low", "Medium", "High", "Very High"]
RATE_BAND_PROBS = [0.2, 0.4, 0.6, 0.8]


def _prune(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df if columns is None else df.select(*columns)


# ---------------------------------------------------------------- exploration


def schema_rows(df: DataFrame) -> DataFrame:
    """Schema as rows ``(column_name, data_type, nullable)`` (printSchema as data)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    schema = "column_name string, data_type string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def summary_statistics(df: DataFrame) -> DataFrame:
    """``describe()``: count / mean / stddev / min / max of every numeric and
    string column, as strings, one row per statistic.

    One global aggregate over one read, so the joins behind a wide view run
    once; it needs no sort, and a task sends on one row.  The few dozen
    results are turned to one row per column and statistic and pivoted back
    to one column per field.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
    if not fields:
        return df.sparkSession.createDataFrame([(s,) for s in _SUMMARY], "summary string")
    aggs, rows = [], []
    for i, f in enumerate(fields):
        c, number = F.col(f.name), isinstance(f.dataType, T.NumericType)
        # decimals and floats as doubles, integers as longs, strings as they are
        ordered = c.cast("long") if isinstance(f.dataType, T.IntegralType) else c.cast("double") if number else c
        aggs += [F.count(c).alias(f"count{i}"), F.min(ordered).alias(f"min{i}"), F.max(ordered).alias(f"max{i}")]
        if number:
            aggs += [F.avg(c.cast("double")).alias(f"mean{i}"), F.stddev(c.cast("double")).alias(f"stddev{i}")]
        values = {s: F.col(f"{s}{i}") if number or s not in ("mean", "stddev") else F.lit(None) for s in _SUMMARY}
        rows.append(F.struct(F.lit(i).alias("i"), *[v.cast("string").alias(s) for s, v in values.items()]))
    stats = df.agg(*aggs).select(F.inline(F.array(*rows)))
    tall = stats.unpivot(["i"], list(_SUMMARY), "summary", "value")
    rank = F.array_position(F.array(*[F.lit(x) for x in _SUMMARY]), F.col("summary"))
    wide = tall.groupBy("summary").pivot("i", list(range(len(fields)))).agg(F.first("value"))
    return wide.orderBy(rank).select("summary", *[F.col(str(i)).alias(f.name) for i, f in enumerate(fields)])


_SUMMARY = ("count", "mean", "stddev", "min", "max")


def policies_by_state(df: DataFrame) -> DataFrame:
    return df.groupBy("acct_st_cd").count().orderBy(F.col("count").desc_nulls_last())


def unique_accounts(df: DataFrame) -> DataFrame:
    """Distinct ``acct_nm`` values, null counted as a value."""
    return df.agg(null_inclusive_distinct("acct_nm").alias("unique_accounts"))


def unique_policies(df: DataFrame) -> DataFrame:
    return df.agg(null_inclusive_distinct("pol_nbr").alias("unique_policies"))


# ---------------------------------------------------------------- time


def with_effective_date(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Policy rows plus ``eff_year`` / ``eff_month`` of ``pol_eff_dt``."""
    return _prune(df, columns).withColumns(
        {"eff_year": F.year("pol_eff_dt"), "eff_month": F.month("pol_eff_dt")}
    )


def policies_by_year_month(df: DataFrame) -> DataFrame:
    return (
        with_effective_date(df, ["pol_eff_dt"])
        .groupBy("eff_year", "eff_month")
        .count()
        .orderBy("eff_year", "eff_month")
    )


def policy_duration_stats(df: DataFrame) -> DataFrame:
    """min / max / avg / exact median of the policy term in days."""
    d = df.select(F.datediff("pol_expir_dt", "pol_eff_dt").alias("policy_duration_days"))
    s = distribution_stats(d, "policy_duration_days", [0.5], name="q")
    return s.select(
        F.col("min").alias("min_days"),
        F.col("max").alias("max_days"),
        F.col("mean").alias("avg_days"),
        F.col("q")[0].alias("median_days"),
    )


def quarterly_trends(df: DataFrame, scale: int | None = None) -> DataFrame:
    return segment_summary(
        df.select(
            F.year("pol_eff_dt").alias("eff_year"), F.quarter("pol_eff_dt").alias("eff_quarter"), "tot_wprm_amt", "rec_id"
        ),
        ["eff_year", "eff_quarter"],
        [
            money_sum("tot_wprm_amt", scale).alias("total_written_premium"),
            money_avg("tot_wprm_amt", scale).alias("avg_written_premium"),
            F.count("rec_id").alias("policy_count"),
        ],
        order=["eff_year", "eff_quarter"],
    )


# ---------------------------------------------------------------- premium


def premium_by_form(df: DataFrame, scale: int | None = None) -> DataFrame:
    return segment_summary(
        df,
        ["pol_fm_cd"],
        policy_triple(names=("policy_count", "total_written_premium", "avg_written_premium"), scale=scale),
        order=["-total_written_premium"],
    ).select("pol_fm_cd", "policy_count", "avg_written_premium", "total_written_premium")


def premium_distribution_stats(df: DataFrame, scale: int | None = None) -> DataFrame:
    """min / quartiles / max / avg / stddev of the written premium (exact quartiles)."""
    s = distribution_stats(df, "tot_wprm_amt", [0.25, 0.5, 0.75], sum_scale=scale, name="q")
    return s.select(
        F.col("min").alias("min_premium"),
        F.col("q")[0].alias("25th_percentile"),
        F.col("q")[1].alias("median_premium"),
        F.col("q")[2].alias("75th_percentile"),
        F.col("max").alias("max_premium"),
        F.col("mean").alias("avg_premium"),
        F.col("stddev").alias("stddev_premium"),
    )


def premium_deciles(df: DataFrame, scale: int | None = None) -> DataFrame:
    """min / max / avg / count of the written premium per decile (``ntile(10)`` order).

    ``policy_count`` counts the records of each decile that have a ``rec_id``
    (of equal premiums, those count as the first).
    """
    t = ntile_summary(df, "tot_wprm_amt", 10, tile_name="premium_decile", sum_scale=scale, counted="rec_id")
    return t.select(
        "premium_decile",
        F.col("min_value").alias("min_premium"),
        F.col("max_value").alias("max_premium"),
        (F.col("sum_value") / F.col("n_rows")).alias("avg_premium"),
        F.col("n_counted").alias("policy_count"),
    ).orderBy("premium_decile")


# ---------------------------------------------------------------- geography


def state_earned_premium(df: DataFrame, scale: int | None = None) -> DataFrame:
    return segment_summary(
        df,
        ["acct_st_cd"],
        policy_triple("cy_yr1_ep_amt", names=("policy_count", "total_earned_premium", "avg_earned_premium"), scale=scale),
        order=["-total_earned_premium"],
    )


def top_cities(df: DataFrame, top: int = 15, scale: int | None = None) -> DataFrame | None:
    if "cty_nm" not in df.columns:
        return None
    return segment_summary(
        df,
        ["acct_st_cd", "cty_nm"],
        [money_sum("tot_wprm_amt", scale).alias("total_premium"), F.count("rec_id").alias("policy_count")],
        order=["-total_premium"],
        top=top,
    )


# ---------------------------------------------------------------- exposure


def _with_exposure_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("premium_to_exposure_ratio", safe_ratio("tot_wprm_amt", "tot_expos_qty"))


def state_exposure_ratio(df: DataFrame) -> DataFrame:
    return segment_summary(
        _with_exposure_ratio(df),
        ["acct_st_cd"],
        [
            F.avg("premium_to_exposure_ratio").alias("avg_premium_per_exposure"),
            F.stddev("premium_to_exposure_ratio").alias("stddev_premium_per_exposure"),
        ],
        order=["-avg_premium_per_exposure"],
    )


def form_exposure(df: DataFrame, scale: int | None = None) -> DataFrame:
    return segment_summary(
        _with_exposure_ratio(df),
        ["pol_fm_cd"],
        [
            money_sum("tot_expos_qty", scale).alias("total_exposure"),
            F.avg("premium_to_exposure_ratio").alias("avg_premium_per_exposure"),
            F.count("rec_id").alias("policy_count"),
        ],
        order=["-total_exposure"],
    )


# ---------------------------------------------------------------- industry


def industry_by_name(df: DataFrame, scale: int | None = None) -> DataFrame:
    return segment_summary(
        df,
        ["indus_grp_nm"],
        policy_triple(names=("policy_count", "total_written_premium", "avg_written_premium"), scale=scale),
        order=["-total_written_premium"],
    )


def industry_by_code(df: DataFrame, scale: int | None = None) -> DataFrame:
    return segment_summary(df, ["indus_grp_cd"], policy_triple(scale=scale), order=["-total_premium"])


# ---------------------------------------------------------------- commission


def state_commission(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Commission by state.  ``comm_amt / tot_wprm_amt`` is unguarded in the
    source; ``try_divide`` gives null on a zero premium instead of failing
    under ANSI mode."""
    d = df.select(
        "acct_st_cd", "comm_pct", "comm_amt", F.try_divide("comm_amt", "tot_wprm_amt").alias("comm_ratio")
    )
    return segment_summary(
        d,
        ["acct_st_cd"],
        [
            money_avg("comm_pct", scale).alias("avg_commission_pct"),
            F.avg("comm_ratio").alias("avg_comm_to_premium_ratio"),
            money_sum("comm_amt", scale).alias("total_commission"),
        ],
        order=["-total_commission"],
    )


def form_commission(df: DataFrame, scale: int | None = None) -> DataFrame:
    return segment_summary(
        df,
        ["pol_fm_cd"],
        [
            money_avg("comm_pct", scale).alias("avg_commission_pct"),
            money_sum("comm_amt", scale).alias("total_commission"),
            F.count(F.lit(1)).alias("policy_count"),
        ],
        order=["-total_commission"],
    )


def waived_commission_by_state(df: DataFrame, scale: int | None = None) -> DataFrame | None:
    if "waiv_comm_amt" not in df.columns:
        return None
    return segment_summary(
        df,
        ["acct_st_cd"],
        [
            money_sum("waiv_comm_amt", scale).alias("total_waived_commission"),
            F.count(F.lit(1)).alias("policies_with_waived_comm"),
        ],
        order=["-total_waived_commission"],
        where=F.col("waiv_comm_amt") > 0,
    )


# ---------------------------------------------------------------- growth


def yoy_growth(df: DataFrame) -> DataFrame:
    """Rows with ``yoy_growth_pct = (yr1 - yr2) / yr2 * 100`` (null unless yr2 > 0)."""
    require_columns(df, ["rec_id", "cy_yr1_wprm_amt", "cy_yr2_wprm_amt"], "yoy_growth")
    yr1, yr2 = F.col("cy_yr1_wprm_amt"), F.col("cy_yr2_wprm_amt")
    return df.select("rec_id", "cy_yr1_wprm_amt", "cy_yr2_wprm_amt").withColumn(
        "yoy_growth_pct", F.when(yr2 > 0, (yr1 - yr2) / yr2 * 100)
    )


def growth_bucket(pct: F.Column) -> F.Column:
    """Growth label.  Kept as in the source: (-0.01, 0) and null are "No Change"."""
    sd, md, mi, si, nc = GROWTH_LABELS
    return label_ladder(
        [(pct < -10, sd), (pct.between(-10, -0.01), md), (pct.between(0, 10), mi), (pct > 10, si)], otherwise=nc
    )


def growth_buckets(df: DataFrame) -> DataFrame:
    g = yoy_growth(df)
    return g.groupBy(growth_bucket(F.col("yoy_growth_pct")).alias("growth_bucket")).count().orderBy("growth_bucket")


# ---------------------------------------------------------------- location / coverage


def location_risk(df: DataFrame, top: int | None = None, scale: int | None = None) -> DataFrame:
    require_columns(df, ["loc_nbr", "rec_id", "bas_rt", "tot_wprm_amt"], "location_risk")
    return segment_summary(
        df,
        ["loc_nbr"],
        [
            F.count("rec_id").alias("policy_count"),
            money_avg("bas_rt", scale).alias("avg_base_rate"),
            money_sum("tot_wprm_amt", scale).alias("total_premium"),
        ],
        order=["-total_premium"],
        top=top,
    )


def coverage_pivot(df: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Policy form x coverage split type, count of ``rec_id``, missing cells 0."""
    require_columns(df, ["pol_fm_cd", "cov_splt_typ_cd", "rec_id"], "coverage_pivot")
    return pivot_count(df, "pol_fm_cd", "cov_splt_typ_cd", "rec_id", values)


# ---------------------------------------------------------------- quarterly patterns


def _quarter_frame(df: DataFrame) -> tuple[DataFrame, list[str]] | None:
    qtrs = existing_columns(df, QUARTER_COLUMNS)
    if not qtrs:
        return None
    yr1 = F.col("cy_yr1_wprm_amt")
    base = df.select("rec_id", *qtrs, "cy_yr1_wprm_amt", "cy_yr2_wprm_amt")
    pct = {f"{q}_pct": F.when(yr1 > 0, (F.col(q) / yr1) * 100) for q in qtrs}
    return base.withColumns(pct), qtrs


def quarterly_pattern(df: DataFrame) -> DataFrame | None:
    """Rows with each existing quarter as a percent of ``cy_yr1_wprm_amt``."""
    r = _quarter_frame(df)
    return None if r is None else r[0]


def avg_quarterly_pattern(df: DataFrame) -> DataFrame | None:
    r = _quarter_frame(df)
    if r is None:
        return None
    frame, qtrs = r
    return frame.agg(*[F.avg(f"{q}_pct").alias(f"avg_{q}_pct") for q in qtrs])


def quarterly_variation(df: DataFrame) -> DataFrame | None:
    """Quarter pattern rows plus ``variation_{i}_to_{i+1}`` between adjacent
    existing quarters (labels count positions among the existing ones)."""
    r = _quarter_frame(df)
    if r is None:
        return None
    frame, qtrs = r
    var = {}
    for i, (cur, nxt) in enumerate(zip(qtrs, qtrs[1:]), start=1):
        c = F.col(cur)
        den = F.when(c > 0, c).otherwise(1)
        var[f"variation_{i}_to_{i + 1}"] = F.abs((F.col(nxt) - c) / den) * 100
    return frame.withColumns(var) if var else frame


def high_variation_policies(df: DataFrame, threshold: float = VARIATION_THRESHOLD, top: int = 10) -> DataFrame | None:
    frame = quarterly_variation(df)
    if frame is None:
        return None
    qtrs = existing_columns(df, QUARTER_COLUMNS)
    var_cols = [c for c in frame.columns if c.startswith("variation_")]
    if not var_cols:
        return None
    return (
        frame.where(any_true([F.col(c) > threshold for c in var_cols]))
        .select("rec_id", *qtrs, *var_cols)
        .orderBy(F.col(var_cols[0]).desc_nulls_last(), F.col("rec_id").asc_nulls_first())
        .limit(top)
    )


# ---------------------------------------------------------------- vehicles


def vehicle_policies(df: DataFrame) -> DataFrame | None:
    """Rows whose first existing vehicle column is non-null, with ``vehicle_make``."""
    have = existing_columns(df, VEHICLE_COLUMNS)
    if not have:
        return None
    out = df.where(F.col(have[0]).isNotNull())
    if "veh_mk_mdl_nm_leg" in have:
        out = out.withColumn("vehicle_make", first_word("veh_mk_mdl_nm_leg"))
    return out


def premium_by_vehicle_make(df: DataFrame, top: int = 15, scale: int | None = None) -> DataFrame | None:
    v = vehicle_policies(df)
    if v is None or "vehicle_make" not in v.columns:
        return None
    return segment_summary(v, ["vehicle_make"], policy_triple(scale=scale), order=["-policy_count"], top=top)


def premium_by_vehicle_class(df: DataFrame, top: int = 10, scale: int | None = None) -> DataFrame | None:
    v = vehicle_policies(df)
    if v is None or "veh_cls_hgh_lvl_desc" not in v.columns:
        return None
    return segment_summary(v, ["veh_cls_hgh_lvl_desc"], policy_triple(scale=scale), order=["-total_premium"], top=top)


def premium_by_vehicle_group(df: DataFrame, top: int = 10, scale: int | None = None) -> DataFrame | None:
    v = vehicle_policies(df)
    if v is None or "veh_grp_typ_cd" not in v.columns:
        return None
    return segment_summary(v, ["veh_grp_typ_cd"], policy_triple(scale=scale), order=["-policy_count"], top=top)


# ---------------------------------------------------------------- risk factors


def premium_by_hazard(df: DataFrame, top: int = 10, scale: int | None = None) -> DataFrame | None:
    if "haz_cd_leg" not in df.columns:
        return None
    require_columns(df, ["bas_rt"], "premium_by_hazard")
    return segment_summary(
        df,
        ["haz_cd_leg"],
        [*policy_triple(scale=scale), money_avg("bas_rt", scale).alias("avg_base_rate")],
        order=["-policy_count"],
        top=top,
        where=F.col("haz_cd_leg").isNotNull(),
    )


def rate_bands(df: DataFrame, scale: int | None = None) -> DataFrame | None:
    """Base-rate quintile bands (exact p20/p40/p60/p80, upper edge inclusive).

    The thresholds stay in the plan as one scalar subquery (a one-row
    aggregate); they never round-trip through driver code.
    """
    if "bas_rt" not in df.columns:
        return None
    rated = df.where(F.col("bas_rt").isNotNull())
    q = exact_quantiles(rated, "bas_rt", RATE_BAND_PROBS, name="q").select("q").scalar()
    r = F.col("bas_rt")
    vl, lo, me, hi, vh = RATE_BANDS
    band = label_ladder([(r <= q[0], vl), (r <= q[1], lo), (r <= q[2], me), (r <= q[3], hi)], otherwise=vh)
    rank = label_ladder([(F.col("rate_band") == b, str(i)) for i, b in enumerate(RATE_BANDS, start=1)]).cast("int")
    return (
        rated.select(band.alias("rate_band"), "rec_id", "bas_rt", "tot_wprm_amt")
        .groupBy("rate_band")
        .agg(
            F.count("rec_id").alias("policy_count"),
            money_avg("bas_rt", scale).alias("avg_base_rate"),
            money_avg("tot_wprm_amt", scale).alias("avg_premium"),
            money_sum("tot_wprm_amt", scale).alias("total_premium"),
        )
        .orderBy(rank)
    )


def premium_by_product(df: DataFrame, top: int = 10, scale: int | None = None) -> DataFrame | None:
    if "rtmk_prdct_cd_leg" not in df.columns:
        return None
    return segment_summary(df, ["rtmk_prdct_cd_leg"], policy_triple(scale=scale), order=["-policy_count"], top=top)


def premium_by_premium_type(df: DataFrame, scale: int | None = None) -> DataFrame | None:
    if "prem_typ_cd" not in df.columns:
        return None
    return segment_summary(df, ["prem_typ_cd"], policy_triple(scale=scale), order=["-policy_count"])


def risk_columns(df: DataFrame) -> DataFrame | None:
    have = existing_columns(df, RISK_COLUMNS)
    if not have:
        return None
    return df.select("rec_id", *have, "tot_wprm_amt")


# ---------------------------------------------------------------- renewals


def premium_by_renewal_status(df: DataFrame, scale: int | None = None) -> DataFrame | None:
    if "new_ren_cd" not in df.columns:
        return None
    return segment_summary(df, ["new_ren_cd"], policy_triple(scale=scale), order=["-policy_count"])


def renewal_by_state(
    df: DataFrame, values: Sequence[str] | None = None, renewed: str = "R", new: str = "N"
) -> DataFrame | None:
    """Status counts per state pivoted to columns; ``renewal_rate`` when both
    the renewed and the new code are among the columns."""
    if "new_ren_cd" not in df.columns:
        return None
    counts = df.groupBy("acct_st_cd", "new_ren_cd").count()
    wide = pivot_sum(counts, "acct_st_cd", "new_ren_cd", "count", values)
    status_cols = [c for c in wide.columns if c != "acct_st_cd"]
    if len(status_cols) > 1 and renewed in status_cols and new in status_cols:
        r, n = F.col(renewed), F.col(new)
        wide = wide.withColumn("renewal_rate", F.try_divide(r, r + n) * 100)
    return wide


def top_renewal_states(df: DataFrame, top: int = 10, values: Sequence[str] | None = None) -> DataFrame | None:
    wide = renewal_by_state(df, values)
    if wide is None or "renewal_rate" not in wide.columns:
        return None
    return wide.orderBy(F.col("renewal_rate").desc_nulls_last(), F.col("acct_st_cd").asc_nulls_first()).limit(top)


def premium_by_status_and_form(df: DataFrame, top: int = 15, scale: int | None = None) -> DataFrame | None:
    if "new_ren_cd" not in df.columns:
        return None
    return segment_summary(
        df, ["new_ren_cd", "pol_fm_cd"], policy_triple(scale=scale), order=["new_ren_cd", "-policy_count"], top=top
    )


# ---------------------------------------------------------------- earned premium


def earned_ratio_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame | None:
    have = existing_columns(df, PREMIUM_COLUMNS)
    if len(have) < 2 or "tot_wprm_amt" not in have or "cy_yr1_ep_amt" not in have:
        return None
    return _prune(df, columns).withColumn("ep_wp_ratio", safe_ratio("cy_yr1_ep_amt", "tot_wprm_amt"))


def earned_ratio_stats(df: DataFrame) -> DataFrame | None:
    e = earned_ratio_rows(df, ["cy_yr1_ep_amt", "tot_wprm_amt"])
    if e is None:
        return None
    r = F.col("ep_wp_ratio")
    return e.agg(
        F.avg(r).alias("avg_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"), F.stddev(r).alias("stddev_ratio")
    )


def _earned_by(df: DataFrame, key: str, top: int, scale: int | None) -> DataFrame | None:
    e = earned_ratio_rows(df, [key, "rec_id", "cy_yr1_ep_amt", "tot_wprm_amt"])
    if e is None:
        return None
    return segment_summary(
        e,
        [key],
        [
            F.avg("ep_wp_ratio").alias("avg_ratio"),
            money_sum("cy_yr1_ep_amt", scale).alias("total_earned_premium"),
            money_sum("tot_wprm_amt", scale).alias("total_written_premium"),
            F.count("rec_id").alias("policy_count"),
        ],
        order=["-policy_count"],
        top=top,
    )


def earned_ratio_by_state(df: DataFrame, top: int = 10, scale: int | None = None) -> DataFrame | None:
    return _earned_by(df, "acct_st_cd", top, scale)


def earned_ratio_by_form(df: DataFrame, top: int = 10, scale: int | None = None) -> DataFrame | None:
    return _earned_by(df, "pol_fm_cd", top, scale)


# ---------------------------------------------------------------- run everything

# result-set name -> report; the first 16 are the named results of the
# source's main entry point, the rest are the sets it only displays.
CATALOGUE = {
    "df_with_date": with_effective_date,
    "premium_by_form": premium_by_form,
    "state_premium": state_earned_premium,
    "state_ratios": state_exposure_ratio,
    "quarterly_premiums": quarterly_trends,
    "industry_summary": industry_by_name,
    "decile_summary": premium_deciles,
    "state_commission": state_commission,
    "growth_summary": growth_buckets,
    "location_risk": location_risk,
    "coverage_summary": coverage_pivot,
    "quarterly_patterns": quarterly_variation,
    "vehicle_data": vehicle_policies,
    "risk_data": risk_columns,
    "renewal_data": renewal_by_state,
    "earned_premium_data": earned_ratio_rows,
    "schema": schema_rows,
    "summary_statistics": summary_statistics,
    "policies_by_state": policies_by_state,
    "unique_accounts": unique_accounts,
    "unique_policies": unique_policies,
    "policies_by_year_month": policies_by_year_month,
    "policy_duration_stats": policy_duration_stats,
    "premium_distribution_stats": premium_distribution_stats,
    "top_cities": top_cities,
    "form_exposure": form_exposure,
    "industry_by_code": industry_by_code,
    "form_commission": form_commission,
    "waived_commission_by_state": waived_commission_by_state,
    "yoy_growth": yoy_growth,
    "location_risk_top10": lambda df: location_risk(df, top=10),
    "quarterly_pattern": quarterly_pattern,
    "avg_quarterly_pattern": avg_quarterly_pattern,
    "high_variation_policies": high_variation_policies,
    "premium_by_vehicle_make": premium_by_vehicle_make,
    "premium_by_vehicle_class": premium_by_vehicle_class,
    "premium_by_vehicle_group": premium_by_vehicle_group,
    "premium_by_hazard": premium_by_hazard,
    "rate_bands": rate_bands,
    "premium_by_product": premium_by_product,
    "premium_by_premium_type": premium_by_premium_type,
    "premium_by_renewal_status": premium_by_renewal_status,
    "top_renewal_states": top_renewal_states,
    "premium_by_status_and_form": premium_by_status_and_form,
    "earned_ratio_stats": earned_ratio_stats,
    "earned_ratio_by_state": earned_ratio_by_state,
    "earned_ratio_by_form": earned_ratio_by_form,
}


def run_all(df: DataFrame, cache: bool = False, names: Sequence[str] | None = None) -> dict:
    """Build every report over one table.

    Returns ``{"results": {name: DataFrame}, "skipped": [names], "source": DataFrame}``;
    ``source`` is the (possibly persisted) table the reports read; call
    ``source.unpersist()`` when done.

    With ``cache=True`` the table is first pruned to the columns the reports
    read and persisted (memory, spilling to disk), so the ~45 result sets
    share one scan instead of re-reading a 500-column table each time.  The
    persisted blocks are rebuilt from lineage if an executor is lost.
    """
    src = df
    if cache:
        used = [c for c in df.columns if c in _USED_COLUMNS]
        src = df.select(*used).persist()
    results, skipped = {}, []
    for name in names or CATALOGUE:
        out = CATALOGUE[name](src)
        if out is None:
            skipped.append(name)
        else:
            results[name] = out
    return {"results": results, "skipped": skipped, "source": src}


_USED_COLUMNS = {
    "rec_id", "acct_nm", "pol_nbr", "acct_st_cd", "cty_nm", "pol_eff_dt", "pol_expir_dt", "pol_fm_cd",
    "cov_splt_typ_cd", "new_ren_cd", "indus_grp_nm", "indus_grp_cd", "tot_wprm_amt", "tot_expos_qty",
    "comm_pct", "comm_amt", "waiv_comm_amt", "cy_yr1_ep_amt", "cy_yr2_ep_amt", "cy_yr1_wprm_amt",
    "cy_yr2_wprm_amt", *QUARTER_COLUMNS, "loc_nbr", "bas_rt", *VEHICLE_COLUMNS, *RISK_COLUMNS,
}
