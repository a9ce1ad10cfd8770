"""The ``policy`` fixture: one wide insurance policy row per line item.

The reports take any DataFrame with the policy columns.  For testing, this
module derives such a table from the star-schema tables (lineitem, orders,
customer, nation, part) so that every report reads data that grows with the
input.  ``POLICY_SQL`` is the same view as SQL text, used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.sources.tables import load_table


def _quarter(i: int) -> F.Column:
    """Quarter ``i`` written premium: linenumber-dependent shares of the price."""
    ln, sk, price = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_extendedprice")
    even = price * ((ln + sk + i) % 4 + 1) / 10.0
    out = F.when(ln % 2 == 0, even)
    if i == 3:
        out = out.when(ln == 3, F.lit(0.0))
    return out.otherwise(price * 0.25)


def policy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the policy table from the star schema (lazy).

    Join plan: orders get their customers and nations first, so the line items
    are shuffled twice only, by order and by part.  The joins are key/foreign-key
    joins between large tables and are left to the optimizer (sort-merge, or
    broadcast-hash once AQE sees a small side), as is the one with ``nation``.
    """
    li = load_table(spark, sf_dir, "lineitem")
    orders = load_table(spark, sf_dir, "orders")
    cust = load_table(spark, sf_dir, "customer")
    nation = load_table(spark, sf_dir, "nation")
    part = load_table(spark, sf_dir, "part")

    ordered = orders.join(cust.join(nation, cust.c_nationkey == nation.n_nationkey), orders.o_custkey == cust.c_custkey)
    j = li.join(part, li.l_partkey == part.p_partkey).join(ordered, li.l_orderkey == orders.o_orderkey)
    ln = F.col("l_linenumber")
    price = F.col("l_extendedprice")
    cols = {
        "rec_id": F.concat("l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey", F.lit("-"), "l_linenumber"),
        "acct_nm": F.col("c_name"),
        "pol_nbr": F.col("o_orderkey"),
        "acct_st_cd": F.col("n_name"),
        "cty_nm": F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")),
        "pol_eff_dt": F.col("o_orderdate"),
        "pol_expir_dt": F.when(F.col("p_size") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL '182' DAY"))
        .otherwise(F.col("o_orderdate") + F.expr("INTERVAL '365' DAY")),
        "pol_fm_cd": F.col("p_type"),
        "cov_splt_typ_cd": F.col("l_returnflag"),
        "new_ren_cd": F.when(F.col("l_linestatus") == "O", "N").otherwise("R"),
        "indus_grp_nm": F.col("c_mktsegment"),
        "indus_grp_cd": F.col("p_size"),
        "tot_wprm_amt": price,
        "tot_expos_qty": F.col("l_quantity") - 1,
        "comm_pct": F.col("l_discount") * 100,
        "comm_amt": price * F.col("l_discount"),
        "waiv_comm_amt": price * F.col("l_tax"),
        "cy_yr1_ep_amt": price * (1 - F.col("l_discount")),
        "cy_yr2_ep_amt": price * (1 - F.col("l_tax")),
        "cy_yr1_wprm_amt": price,
        "cy_yr2_wprm_amt": F.when(ln == 7, F.lit(0.0))
        .when(ln == 6, price)
        .otherwise(F.col("l_quantity") * F.col("p_retailprice") * 2),
        **{f"cy_qtr{i}_wprm_amt": _quarter(i) for i in range(1, 9)},
        "loc_nbr": F.col("l_suppkey"),
        "bas_rt": F.col("p_retailprice") / 100,
        "vin": F.when(ln == 1, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("VIN"), F.col("l_partkey").cast("string"))
        ),
        "veh_mk_mdl_nm_leg": F.col("p_name"),
        "veh_cls_hgh_lvl_desc": F.col("p_type"),
        "veh_grp_typ_cd": F.col("p_brand"),
        "haz_cd_leg": F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")),
        "rtmk_prdct_cd_leg": F.col("p_brand"),
        "prem_typ_cd": F.col("o_orderpriority"),
    }
    return j.select(*[c.alias(n) for n, c in cols.items()])


# The policy view as SQL text (runs in Spark SQL and DuckDB over the
# pre-registered star-schema views).  Fixed fixture definition.
POLICY_SQL = """
SELECT
  l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS rec_id,
  c_name AS acct_nm, o_orderkey AS pol_nbr, n_name AS acct_st_cd,
  concat(n_name,'/',c_mktsegment) AS cty_nm,
  o_orderdate AS pol_eff_dt,
  CASE WHEN p_size%3=0 THEN o_orderdate + INTERVAL '182' DAY ELSE o_orderdate + INTERVAL '365' DAY END AS pol_expir_dt,
  p_type AS pol_fm_cd, l_returnflag AS cov_splt_typ_cd,
  CASE WHEN l_linestatus='O' THEN 'N' ELSE 'R' END AS new_ren_cd,
  c_mktsegment AS indus_grp_nm, p_size AS indus_grp_cd,
  l_extendedprice AS tot_wprm_amt, l_quantity-1 AS tot_expos_qty,
  l_discount*100 AS comm_pct, l_extendedprice*l_discount AS comm_amt,
  l_extendedprice*l_tax AS waiv_comm_amt,
  l_extendedprice*(1-l_discount) AS cy_yr1_ep_amt, l_extendedprice*(1-l_tax) AS cy_yr2_ep_amt,
  l_extendedprice AS cy_yr1_wprm_amt,
  CASE WHEN l_linenumber=7 THEN 0e0 WHEN l_linenumber=6 THEN l_extendedprice
       ELSE l_quantity*p_retailprice*2 END AS cy_yr2_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+1)%4+1)/10e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr1_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+2)%4+1)/10e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr2_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+3)%4+1)/10e0 WHEN l_linenumber=3 THEN 0e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr3_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+4)%4+1)/10e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr4_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+5)%4+1)/10e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr5_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+6)%4+1)/10e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr6_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+7)%4+1)/10e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr7_wprm_amt,
  CASE WHEN l_linenumber%2=0 THEN l_extendedprice*((l_linenumber+l_suppkey+8)%4+1)/10e0 ELSE l_extendedprice*0.25e0 END AS cy_qtr8_wprm_amt,
  l_suppkey AS loc_nbr, p_retailprice/100 AS bas_rt,
  CASE WHEN l_linenumber=1 THEN NULL ELSE concat('VIN',CAST(l_partkey AS VARCHAR(20))) END AS vin,
  p_name AS veh_mk_mdl_nm_leg, p_type AS veh_cls_hgh_lvl_desc, p_brand AS veh_grp_typ_cd,
  CASE WHEN p_size%10=0 THEN NULL ELSE p_size END AS haz_cd_leg,
  p_brand AS rtmk_prdct_cd_leg, o_orderpriority AS prem_typ_cd
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN nation ON c_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey
"""
