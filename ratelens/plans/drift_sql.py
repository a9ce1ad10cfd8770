"""Reference SQL (DuckDB dialect) for the monitors, used as correctness oracles.

Means are exact decimal(18,4) sums, matching the monitors run with
``mean_scale=4`` (the test tables hold amounts with at most 2 decimals).

The SQL computes the same definitions as ``ratelens.operators.drift_metrics``
the straightforward way (window functions over whole partitions, exact
``quantile_cont`` over raw rows), which is what the distributed plan must
reproduce.  Floating-point accumulations are rounded to ``digits``.
"""

from __future__ import annotations

from collections.abc import Sequence

JSD_DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _long(
    table: str, ts: str, numeric: Sequence[str], categorical: Sequence[str], slices: Sequence[str], groups: Sequence[str] = ()
) -> str:
    g = "".join(f"{c}, " for c in groups)
    parts = []
    for label, pred in [("all", "TRUE"), *[(s, s) for s in slices]]:
        for c in numeric:
            parts.append(
                f"SELECT CAST(date_trunc('month', {ts}) AS DATE) AS ws, {_q(label)} AS slice, {g}{_q(c)} AS column_name, 'n' AS kind, "
                f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END AS num, CAST(NULL AS VARCHAR) AS cat "
                f"FROM {table} WHERE {pred}"
            )
        for c in categorical:
            parts.append(
                f"SELECT CAST(date_trunc('month', {ts}) AS DATE) AS ws, {_q(label)} AS slice, {g}{_q(c)} AS column_name, 'c' AS kind, "
                f"CAST(NULL AS DOUBLE) AS num, CAST({c} AS VARCHAR) AS cat FROM {table} WHERE {pred}"
            )
    return "\nUNION ALL ".join(parts)


def drift_time_series_sql(
    table: str,
    ts: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    slices: Sequence[str] = (),
    digits: int = 6,
    groups: Sequence[str] = (),
) -> str:
    G = "".join(f"{c}, " for c in groups)
    K = f"window_start, slice, {G}column_name"
    R = lambda e: f"round({e}, {digits})"
    return f"""
WITH long AS ({_long(table, ts, numeric, categorical, slices, groups)}),
vc AS (SELECT ws, slice, {G}column_name, kind, num, cat, count(*) AS n FROM long GROUP BY ALL),
paired AS (
  SELECT window_start, slice, {G}column_name, kind, num, cat, sum(n_b) AS n_b, sum(n_c) AS n_c FROM (
    SELECT ws AS window_start, slice, {G}column_name, kind, num, cat, 0 AS n_b, n AS n_c FROM vc
    UNION ALL
    SELECT CAST(ws + INTERVAL 1 MONTH AS DATE), slice, {G}column_name, kind, num, cat, n, 0 FROM vc) GROUP BY ALL),
nump AS (SELECT {K}, num AS value, n_b, n_c FROM paired WHERE kind = 'n'),
nstats AS (
  SELECT {K},
    sum(CASE WHEN value IS NOT NULL THEN n_b ELSE 0 END) AS Nb, sum(CASE WHEN value IS NOT NULL THEN n_c ELSE 0 END) AS Nc,
    sum(n_b) AS Tb, sum(n_c) AS Tc,
    round(fsum(value * n_b), 4) / nullif(sum(CASE WHEN value IS NOT NULL THEN n_b END), 0) AS mean_b,
    round(fsum(value * n_c), 4) / nullif(sum(CASE WHEN value IS NOT NULL THEN n_c END), 0) AS mean_c,
    min(CASE WHEN value IS NOT NULL AND n_b > 0 THEN value END) AS min_b,
    max(CASE WHEN value IS NOT NULL AND n_b > 0 THEN value END) AS max_b
  FROM nump GROUP BY ALL),
cdf AS (
  SELECT v.*, s.Nb, s.Nc, s.mean_b,
    sum(n_b) OVER w AS cb, sum(n_c) OVER w AS cc,
    lead(value) OVER (PARTITION BY {K} ORDER BY value) AS nv
  FROM nump v JOIN nstats s USING ({K}) WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY {K} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dist AS (
  SELECT {K},
    max(abs(cb / nullif(Nb, 0) - cc / nullif(Nc, 0))) AS ks,
    sum(coalesce(abs(cb / nullif(Nb, 0) - cc / nullif(Nc, 0)) * (nv - value), 0)) AS w,
    sqrt(sum(n_b * (value - mean_b) * (value - mean_b)) / nullif(sum(n_b) - 1, 0)) AS sd_b
  FROM cdf GROUP BY ALL),
dec AS (
  SELECT CAST(ws + INTERVAL 1 MONTH AS DATE) AS window_start, slice, {G}column_name, quantile_cont(num, {JSD_DECILES}) AS d
  FROM long WHERE kind = 'n' AND num IS NOT NULL GROUP BY ALL),
bins AS (
  SELECT {K}, s.Nb, s.Nc, v.n_b, v.n_c,
    CASE WHEN v.value < s.min_b THEN -1 WHEN v.value > s.max_b THEN 1048576
         ELSE len(list_filter(list_distinct(list_prepend(s.min_b, d.d)), lambda e: e <= v.value)) END AS bin
  FROM nump v JOIN nstats s USING ({K}) JOIN dec d USING ({K}) WHERE v.value IS NOT NULL),
nshares AS (SELECT {K}, bin, sum(n_b) / nullif(any_value(Nb), 0) AS pb, sum(n_c) / nullif(any_value(Nc), 0) AS pc FROM bins GROUP BY ALL),
njs AS (
  SELECT {K}, sum(0.5 * CASE WHEN pb > 0 THEN pb * log2(pb / ((pb + pc) / 2)) ELSE 0 END
                + 0.5 * CASE WHEN pc > 0 THEN pc * log2(pc / ((pb + pc) / 2)) ELSE 0 END) AS js
  FROM nshares GROUP BY ALL),
num_out AS (
  SELECT {K}, s.Nb AS n_baseline, s.Nc AS n_current,
    (s.Tc - s.Nc) / nullif(s.Tc, 0) - (s.Tb - s.Nb) / nullif(s.Tb, 0) AS null_rate_delta,
    abs(s.mean_c - s.mean_b) AS mean_drift,
    CASE WHEN s.Nb > 0 AND s.Nc > 0 THEN d.ks END AS ks_stat,
    CASE WHEN s.Nb > 0 AND s.Nc > 0 THEN
      CASE WHEN d.ks * sqrt(s.Nb * s.Nc / (s.Nb + s.Nc)) < 0.2 THEN 1.0
      ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
             lambda j: pow(-1.0, j - 1) * exp(-2.0 * j * j * pow(d.ks * sqrt(s.Nb * s.Nc / (s.Nb + s.Nc)), 2)))))) END END AS ks_p_value,
    CASE WHEN s.Nb > 0 AND s.Nc > 0 THEN d.w END AS wasserstein_distance,
    CASE WHEN s.Nb > 0 AND s.Nc > 0 AND d.sd_b > 0 THEN d.w / d.sd_b END AS wasserstein_norm,
    CASE WHEN s.Nb > 0 AND s.Nc > 0 THEN j.js END AS js_divergence,
    CASE WHEN s.Tb = 0 THEN 'NO_BASELINE' WHEN s.Tc = 0 THEN 'NO_CURRENT' ELSE 'OK' END AS status
  FROM nstats s LEFT JOIN dist d USING ({K}) LEFT JOIN njs j USING ({K})),
catp AS (SELECT {K}, cat AS value, n_b, n_c FROM paired WHERE kind = 'c'),
cstats AS (
  SELECT {K}, sum(n_b) AS Tb, sum(n_c) AS Tc,
    sum(CASE WHEN value IS NOT NULL THEN n_b ELSE 0 END) AS Nb, sum(CASE WHEN value IS NOT NULL THEN n_c ELSE 0 END) AS Nc
  FROM catp GROUP BY ALL),
cshares AS (SELECT {K}, c.n_b / nullif(s.Tb, 0) AS pb, c.n_c / nullif(s.Tc, 0) AS pc FROM catp c JOIN cstats s USING ({K})),
cjs AS (
  SELECT {K}, sum(0.5 * CASE WHEN pb > 0 THEN pb * log2(pb / ((pb + pc) / 2)) ELSE 0 END
                + 0.5 * CASE WHEN pc > 0 THEN pc * log2(pc / ((pb + pc) / 2)) ELSE 0 END) AS js
  FROM cshares GROUP BY ALL),
cat_out AS (
  SELECT {K}, s.Nb AS n_baseline, s.Nc AS n_current,
    (s.Tc - s.Nc) / nullif(s.Tc, 0) - (s.Tb - s.Nb) / nullif(s.Tb, 0) AS null_rate_delta,
    CAST(NULL AS DOUBLE) AS mean_drift, CAST(NULL AS DOUBLE) AS ks_stat, CAST(NULL AS DOUBLE) AS ks_p_value,
    CAST(NULL AS DOUBLE) AS wasserstein_distance, CAST(NULL AS DOUBLE) AS wasserstein_norm,
    CASE WHEN s.Tb > 0 AND s.Tc > 0 THEN j.js END AS js_divergence,
    CASE WHEN s.Tb = 0 THEN 'NO_BASELINE' WHEN s.Tc = 0 THEN 'NO_CURRENT' ELSE 'OK' END AS status
  FROM cstats s LEFT JOIN cjs j USING ({K})),
drift AS (SELECT * FROM num_out UNION ALL SELECT * FROM cat_out)
SELECT window_start, CAST(window_start - INTERVAL 1 MONTH AS DATE) AS baseline_start, slice, {G}column_name,
  n_baseline, n_current, null_rate_delta, mean_drift, ks_stat, {R('ks_p_value')} AS ks_p_value,
  {R('wasserstein_distance')} AS wasserstein_distance, {R('wasserstein_norm')} AS wasserstein_norm,
  {R('js_divergence')} AS js_divergence, status
FROM drift WHERE window_start <= (SELECT max(ws) FROM vc)
"""


def profile_sql(
    table: str,
    ts: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    slices: Sequence[str] = (),
    digits: int = 6,
    groups: Sequence[str] = (),
) -> str:
    R = lambda e: f"round({e}, {digits})"
    G = "".join(f"{c}, " for c in groups)
    return f"""
WITH long AS ({_long(table, ts, numeric, categorical, slices, groups)}),
nums AS (
  SELECT ws AS window_start, slice, {G}column_name, 'numeric' AS data_type, count(*) AS row_count,
    count(*) - count(num) AS null_count, count(DISTINCT num) AS distinct_count,
    min(num) AS min_value, max(num) AS max_value, round(fsum(num), 4) / nullif(count(num), 0) AS mean, {R('stddev_samp(num)')} AS stddev,
    {R('quantile_cont(num, 0.25)')} AS p25, {R('quantile_cont(num, 0.5)')} AS p50, {R('quantile_cont(num, 0.75)')} AS p75
  FROM long WHERE kind = 'n' GROUP BY ALL),
cats AS (
  SELECT ws AS window_start, slice, {G}column_name, 'categorical' AS data_type, count(*) AS row_count,
    count(*) - count(cat) AS null_count, count(DISTINCT cat) AS distinct_count,
    CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean,
    CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75
  FROM long WHERE kind = 'c' GROUP BY ALL)
SELECT *, null_count / row_count AS null_rate FROM (SELECT * FROM nums UNION ALL SELECT * FROM cats)
"""


def sketch_drift_sql(
    table: str,
    ts: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    slices: Sequence[str],
    baseline: str,
    points: int,
    digits: int = 6,
) -> str:
    """The sketched monitor, its grid learned from the month ``baseline``: cells, then the metrics and both error bounds."""
    R = lambda e: f"round({e}, {digits})"
    K = "window_start, slice, column_name"
    probs = "[" + ", ".join(repr(i / (points - 1)) for i in range(points)) + "]"
    return f"""
WITH long AS ({_long(table, ts, numeric, categorical, slices)}),
grid AS (
  SELECT column_name, list_distinct(quantile_disc(num, {probs})) AS e FROM long
  WHERE kind = 'n' AND slice = 'all' AND num IS NOT NULL AND ws = DATE '{baseline}' GROUP BY column_name),
celled AS (
  SELECT l.*, CASE WHEN kind = 'n' THEN 2 * len(list_filter(e, lambda v: v < num)) + CASE WHEN list_contains(e, num) THEN 1 ELSE 0 END END AS cell
  FROM long l LEFT JOIN grid USING (column_name)),
cells AS (
  SELECT ws, slice, column_name, kind, CASE WHEN num IS NOT NULL THEN cell END AS cell, cat, count(*) AS n, min(num) AS lo, max(num) AS hi
  FROM celled GROUP BY ALL),
last AS (SELECT max(ws) AS ws FROM long),
sides AS (
  SELECT ws AS window_start, slice, column_name, kind, cell, cat, 'c' AS side, n, lo, hi FROM cells
  UNION ALL
  SELECT CAST(ws + INTERVAL 1 MONTH AS DATE), slice, column_name, kind, cell, cat, 'b', n, lo, hi FROM cells
  WHERE ws + INTERVAL 1 MONTH <= (SELECT ws FROM last)),
paired AS (
  SELECT {K}, kind, cell, cat, coalesce(sum(n) FILTER (side = 'b'), 0) AS n_b, coalesce(sum(n) FILTER (side = 'c'), 0) AS n_c,
    min(lo) AS lo, max(hi) AS hi, min(lo) FILTER (side = 'b') AS lo_b, max(hi) FILTER (side = 'b') AS hi_b
  FROM sides GROUP BY ALL),
whole AS (
  SELECT ws, slice, column_name, avg(num) AS mean, stddev_samp(num) AS sd FROM long GROUP BY ALL),
stats AS (
  SELECT {K}, any_value(kind) AS kind, sum(n_b) AS Tb, sum(n_c) AS Tc,
    coalesce(sum(n_b) FILTER (cell IS NOT NULL OR cat IS NOT NULL), 0) AS Nb,
    coalesce(sum(n_c) FILTER (cell IS NOT NULL OR cat IS NOT NULL), 0) AS Nc, min(lo_b) AS lo_b, max(hi_b) AS hi_b
  FROM paired GROUP BY ALL),
course AS (
  SELECT {K}, p.lo, p.hi, s.lo_b AS min_b, s.hi_b AS max_b, n_b / nullif(Nb, 0) AS pb, n_c / nullif(Nc, 0) AS pc,
    sum(n_b) OVER w / nullif(Nb, 0) - sum(n_c) OVER w / nullif(Nc, 0) AS d1,
    (sum(n_b) OVER w - n_b) / nullif(Nb, 0) - (sum(n_c) OVER w - n_c) / nullif(Nc, 0) AS d0,
    (sum(n_b) OVER w - n_b) / nullif(Nb, 0) AS before_b, lead(p.lo) OVER w AS next_lo
  FROM paired p JOIN stats s USING ({K}) WHERE p.kind = 'n' AND cell IS NOT NULL
  WINDOW w AS (PARTITION BY {K} ORDER BY cell)),
dist AS (
  SELECT {K}, max(abs(d1)) AS ks,
    max(CASE WHEN hi > lo THEN greatest(abs(d1), abs(d0 + pb), abs(d0 - pc)) ELSE abs(d1) END) AS ks_high,
    sum((hi - lo) * CASE WHEN d0 * d1 >= 0 THEN (abs(d0) + abs(d1)) / 2 ELSE (d0 * d0 + d1 * d1) / (2 * (abs(d0) + abs(d1))) END
      + coalesce(abs(d1) * (next_lo - hi), 0)) AS w,
    sum((hi - lo) * ((pb + pc) / 2 + abs(pb - pc) / 4)) AS w_error
  FROM course GROUP BY ALL),
shares AS (
  SELECT {K}, CASE WHEN hi < min_b THEN -1 WHEN lo > max_b THEN 10 ELSE least(floor(before_b * 10), 9) END AS tenth, sum(pb) AS pb, sum(pc) AS pc
  FROM course GROUP BY ALL
  UNION ALL
  SELECT {K}, row_number() OVER (), n_b / nullif(Tb, 0), n_c / nullif(Tc, 0) FROM paired p JOIN stats s USING ({K}) WHERE p.kind = 'c'),
js AS (
  SELECT {K}, sum(0.5 * CASE WHEN pb > 0 THEN pb * log2(pb / ((pb + pc) / 2)) ELSE 0 END
                + 0.5 * CASE WHEN pc > 0 THEN pc * log2(pc / ((pb + pc) / 2)) ELSE 0 END) AS js
  FROM shares GROUP BY ALL),
out AS (
  SELECT s.*, d.* EXCLUDE ({K}), j.js, b.mean AS mean_b, b.sd AS sd_b, c.mean AS mean_c, Nb > 0 AND Nc > 0 AND s.kind = 'n' AS ok
  FROM stats s LEFT JOIN dist d USING ({K}) LEFT JOIN js j USING ({K})
  LEFT JOIN whole b ON b.ws = s.window_start - INTERVAL 1 MONTH AND b.slice = s.slice AND b.column_name = s.column_name
  LEFT JOIN whole c ON c.ws = s.window_start AND c.slice = s.slice AND c.column_name = s.column_name)
SELECT window_start, CAST(window_start - INTERVAL 1 MONTH AS DATE) AS baseline_start, slice, column_name, Nb::BIGINT AS n_baseline, Nc::BIGINT AS n_current,
  {R('(Tc - Nc) / nullif(Tc, 0) - (Tb - Nb) / nullif(Tb, 0)')} AS null_rate_delta,
  {R('CASE WHEN Tb > 0 THEN abs(mean_c - mean_b) END')} AS mean_drift, {R('CASE WHEN ok THEN ks END')} AS ks_stat,
  {R('''CASE WHEN ok THEN CASE WHEN ks * sqrt(Nb * Nc / (Nb + Nc)) < 0.2 THEN 1.0
    ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
      lambda j: pow(-1.0, j - 1) * exp(-2.0 * j * j * pow(ks * sqrt(Nb * Nc / (Nb + Nc)), 2)))))) END END''')} AS ks_p_value,
  {R('CASE WHEN ok THEN w END')} AS wasserstein_distance, {R('CASE WHEN ok AND sd_b > 0 THEN w / sd_b END')} AS wasserstein_norm,
  {R("CASE WHEN ok OR (kind = 'c' AND Tb > 0 AND Tc > 0) THEN js END")} AS js_divergence,
  CASE WHEN Tb = 0 THEN 'NO_BASELINE' WHEN Tc = 0 THEN 'NO_CURRENT' ELSE 'OK' END AS status,
  {R('CASE WHEN ok THEN ks_high - ks END')} AS ks_error, {R('CASE WHEN ok THEN w_error END')} AS wasserstein_error
FROM out
"""
