"""Two-sample drift metrics over pre-aggregated value counts.

Categories come as a *paired count frame*: one row per ``(keys..., value)`` with
the number of baseline rows ``n_b`` and current rows ``n_c`` holding that value
(null value = the column's null count).  ``keys`` identify one comparison,
e.g. ``(window_start, baseline_start, slice, column_name)``.  Numbers come as
the counts of each sample, and are paired only after their shuffle (see
:func:`numeric_drift`).  Work after the count aggregation is proportional to
the number of distinct values, never to the number of rows, and every key is
computed in the same plan.

Definitions (B = baseline sample of size n, C = current sample of size m,
nulls removed; F_B, F_C empirical CDFs on the union of distinct values
x_1 < ... < x_k):

* ``ks_stat``   max_i |F_B(x_i) - F_C(x_i)|
* ``ks_p_value`` asymptotic Kolmogorov: 2 * sum_{j=1..100} (-1)^(j-1) exp(-2 j^2 l^2),
  l = D sqrt(nm / (n + m)), clamped to [0, 1]; 1 when l < 0.2 (the
  truncated series has not converged there, its limit is 1)
* ``wasserstein_distance`` sum_i |F_B(x_i) - F_C(x_i)| (x_{i+1} - x_i); ``wasserstein_norm`` = W / stddev(B)
* ``js_divergence`` base-2 Jensen-Shannon of bin shares; numeric bins use
  edges learnt from the baseline: (-inf, min_B), [min_B, d_1), ..., [d_9, max_B],
  (max_B, +inf) with d_i the exact deciles of B (empty bins dropped);
  categorical columns use category shares with null as a category
* ``mean_drift`` |mean_C - mean_B|;  ``null_rate_delta`` null_rate_C - null_rate_B
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.lineage import stored
from ratelens.operators.profile import weighted_total

# Fixed values of the metric definitions.
KS_TERMS = 100
KS_SMALL_LAMBDA = 0.2
#: A series' counts are dealt by value into ranges of about RANGE_ROWS, at most RANGES of them.
RANGES, RANGE_ROWS = 1024, 200_000
#: About so many counts give the borders of the ranges; they decide who does the work, not the results.
BORDER_ROWS = 1_000_000
JSD_DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]

DRIFT_COLUMNS = [
    "n_baseline", "n_current", "null_rate_delta", "mean_drift", "ks_stat", "ks_p_value",
    "wasserstein_distance", "wasserstein_norm", "js_divergence", "status",
]


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    lam = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc + F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * lam * lam),
    )
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    return F.when((n > 0) & (m > 0), F.when(lam < KS_SMALL_LAMBDA, F.lit(1.0)).otherwise(p))


def _xlogx_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def jsd_term(pb: Column, pc: Column) -> Column:
    """One bin's part of the base-2 Jensen-Shannon divergence."""
    m = (pb + pc) / 2
    return 0.5 * _xlogx_term(pb, m) + 0.5 * _xlogx_term(pc, m)


def jsd_from_shares(binned: DataFrame, keys: Sequence[str], nb: str = "p_b", nc: str = "p_c") -> DataFrame:
    """Jensen-Shannon divergence per key from per-bin shares ``p_b``, ``p_c``."""
    return binned.groupBy(*keys).agg(F.sum(jsd_term(F.col(nb), F.col(nc))).alias("js_divergence"))


def drift_status(total_b: Column, total_c: Column) -> Column:
    return F.when(total_b == 0, "NO_BASELINE").when(total_c == 0, "NO_CURRENT").otherwise("OK")


def _with_ranges(counts: DataFrame, ranges: int | None) -> DataFrame:
    """``counts``, stored, with ``_part``: the value's range among about equally full ones of its series (null: -1).

    The borders are approximate quantiles; the driver holds at most ``RANGES`` a series.
    """
    null = F.col("value").isNull()
    if ranges is None:
        largest = counts.groupBy("_series").count().agg(F.max("count")).first()[0] or 0
        ranges = largest // RANGE_ROWS
    ranges = min(ranges, RANGES)
    if ranges < 2:
        return counts.withColumn("_part", F.when(null, -1).otherwise(0))
    rows = counts.count()
    some = counts.sample(min(1.0, BORDER_ROWS / rows), seed=0) if rows > BORDER_ROWS else counts
    probs = [k / ranges for k in range(1, ranges)]
    learned = some.where(~null).groupBy("_series").agg(F.percentile_approx("value", probs, 10 * ranges))
    borders = {series: np.array(at) for series, at in learned.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            series, value = b["_series"].to_numpy(), b["value"].to_numpy(zero_copy_only=False)
            part = np.zeros(len(value), "int32")
            for one in np.unique(series):
                mine = series == one
                # a series that the sample missed is one range
                part[mine] = np.searchsorted(borders.get(one, value[:0]), value[mine], "right")
            part[np.isnan(value)] = -1
            yield b.append_column("_part", pa.array(part))

    return stored(counts.mapInArrow(place, T.StructType([*counts.schema.fields, T.StructField("_part", T.IntegerType())])))


def _compare_ranges() -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A task's part: one range of a series' counts, in order, for every comparison it has rows in.

    Self-contained, so executors need not import this package.
    """
    deciles = list(JSD_DECILES)

    def run(counts: pa.Table, starts: pa.Table) -> pa.Table:
        ids, value, n = (counts[c].to_numpy() for c in ("_id", "value", "n"))
        order = np.lexsort((value, ids))
        ids, value, n = ids[order], value[order], n[order]

        def of(sample: int | None) -> tuple[np.ndarray, np.ndarray]:
            if sample is None:
                return value[:0], n[:0]
            at = slice(*np.searchsorted(ids, [sample, sample + 1]))
            return value[at], n[at]

        out = []
        for r in starts.to_pylist():
            (vb, nb), (vc, nc) = of(r["_id_b"]), of(r["_id_c"])
            v = np.concatenate([vb, vc])
            by_value = np.argsort(v, kind="stable")
            v = v[by_value]
            last = np.append(v[1:] != v[:-1], True)  # a value that both samples hold counts in both at once
            at_b = np.concatenate([nb, np.zeros_like(nc)])[by_value]
            at_c = np.concatenate([np.zeros_like(nb), nc])[by_value]
            ks = distance = spread = None
            ranks: list[float | None] = [None] * (2 * len(deciles))
            if r["_Nb"] and r["_Nc"]:
                x = v[last]
                gap = np.abs((r["_before_b"] + np.cumsum(at_b)[last]) / r["_Nb"] - (r["_before_c"] + np.cumsum(at_c)[last]) / r["_Nc"])
                following = np.append(x[1:], x[-1] if r["_next_least"] is None else r["_next_least"])
                ks, distance = float(gap.max()), float((gap * (following - x)).sum())
            if len(vb):
                spread = float((nb * (vb - r["_mean_b"]) ** 2).sum())
                upto = r["_before_b"] + np.cumsum(nb)
                for i, p in enumerate(deciles):
                    pos = p * (r["_Nb"] - 1)
                    for j, rank in enumerate((np.floor(pos), np.ceil(pos))):
                        if r["_before_b"] <= rank < upto[-1]:
                            ranks[2 * i + j] = float(vb[np.searchsorted(upto, rank, "right")])
            out.append((r["_cmp"], ks, distance, spread, *ranks))
        names = ["_cmp", "ks", "distance", "spread", *[f"_{x}{i}" for i in range(len(deciles)) for x in ("lo", "hi")]]
        kinds = [pa.int64()] + [pa.float64()] * (len(names) - 1)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def numeric_drift(
    counts: DataFrame,
    keys: Sequence[str],
    sample: Sequence[str],
    pair: Callable[[DataFrame], DataFrame],
    buckets: int | None = None,
    mean_scale: int | None = None,
) -> DataFrame:
    """Drift metrics per key from the stored value counts of every sample.

    ``counts``: one row per ``(*sample, value)`` with its count ``n``, and the
    ``_series`` (column and slice) it belongs to.  ``pair`` gives a row to the
    comparisons its sample takes part in: it sets ``keys``, tells by ``_is_b``
    whether the row is baseline there, and leaves other columns alone.

    Plan: counts per sample and value range give every range its offsets in the
    CDFs; the counts are shuffled once by series and range, not yet paired, and
    each range is put in order and compared in one task, which gives its part
    of KS, Wasserstein, spread and the baseline's exact deciles.  A last read of
    the counts bins them at these for the JSD, without a shuffle of rows.
    ``mean_scale``: exact decimal means (see ``profile.weighted_mean``);
    ``buckets``: value ranges of a series.
    """
    keys, sample = list(keys), list(sample)
    v, n, is_b = F.col("value"), F.col("n"), F.col("_is_b")

    def side(c: str, base: bool) -> Column:
        return F.when(is_b if base else ~is_b, F.col(c))

    def total(c: str, base: bool) -> Column:
        return F.coalesce(F.sum(side(c, base)), F.lit(0))

    placed = _with_ranges(counts, buckets)
    per_range = stored(
        placed.groupBy(*sample, "_series", "_part").agg(
            F.sum(n).alias("_n"), weighted_total(v, n, mean_scale).alias("_total"), F.min(v).alias("_least"), F.max(v).alias("_most")
        )
    )
    with_value = F.col("_part") >= 0
    per_sample = stored(
        per_range.groupBy(*sample)
        .agg(
            F.sum("_n").alias("_T"),
            F.coalesce(F.sum(F.when(with_value, F.col("_n"))), F.lit(0)).alias("_N"),
            F.sum("_total").cast("double").alias("_total"),
            F.min("_least").alias("_least"),
            F.max("_most").alias("_most"),
        )
        .select("*", F.try_divide("_total", "_N").alias("_mean"), F.monotonically_increasing_id().alias("_id"))
    )
    stats = stored(
        pair(per_sample)
        .groupBy(*keys)
        .agg(
            *[total(f"_{c}", base).alias(f"_{c}{x}") for c in "TN" for base, x in ((True, "b"), (False, "c"))],
            *[F.max(side(f"_{c}", base)).alias(f"_{c}_{x}") for c in ("id", "mean") for base, x in ((True, "b"), (False, "c"))],
            F.max(side("_least", True)).alias("_min_b"),
            F.max(side("_most", True)).alias("_max_b"),
        )
        .withColumn("_cmp", F.monotonically_increasing_id())
    )
    Nb, Nc = F.col("_Nb"), F.col("_Nc")
    # where every comparison's range begins: counts before it, and the first value after it
    slot = (F.col("_series") * F.lit(RANGES) + F.col("_part")).alias("_slot")
    starts = (
        pair(per_range.where(with_value))
        .groupBy(*keys, slot)
        .agg(total("_n", True).alias("_nb"), total("_n", False).alias("_nc"), F.min("_least").alias("_least"))
    )
    across = Window.partitionBy(*keys).orderBy("_slot")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_nb").over(earlier), F.lit(0)).alias("_before_b"),
        F.coalesce(F.sum("_nc").over(earlier), F.lit(0)).alias("_before_c"),
        F.lead("_least").over(across).alias("_next_least"),
    )
    starts = starts.join(stats.select(*keys, "_cmp", "_id_b", "_id_c", "_Nb", "_Nc", "_mean_b"), keys).drop(*keys)
    dealt = placed.where(with_value).join(per_sample.select(*sample, "_id"), sample).select(slot, "_id", "value", "n")
    at = [F.lit(p) * (Nb - 1) for p in JSD_DECILES]
    ends = [f"_{x}{i}" for i in range(len(at)) for x in ("lo", "hi")]
    schema = "_cmp long, ks double, distance double, spread double, " + ", ".join(f"{c} double" for c in ends)
    parts = dealt.groupBy("_slot").cogroup(starts.groupBy("_slot")).applyInArrow(_compare_ranges(), schema)
    dist = parts.groupBy("_cmp").agg(
        F.max("ks").alias("ks_stat"),
        F.sum("distance").alias("wasserstein_distance"),
        F.sum("spread").alias("_spread"),
        *[F.max(c).alias(c) for c in ends],
    )
    dist = stored(stats.join(dist, "_cmp", "left").withColumn("_sd_b", F.sqrt(F.try_divide("_spread", Nb - 1))))
    # JSD bins from the baseline's exact deciles (interpolated as Spark's percentile);
    # edges min_B <= d_1 <= ... <= d_9 as columns; equal neighbours count once
    deciles = [
        F.when((F.floor(q) == F.ceil(q)) | (F.col(f"_lo{i}") == F.col(f"_hi{i}")), F.col(f"_lo{i}")).otherwise(
            (F.ceil(q) - q) * F.col(f"_lo{i}") + (q - F.floor(q)) * F.col(f"_hi{i}")
        )
        for i, q in enumerate(at)
    ]
    edges = dist.where(Nb > 0).select(
        *keys, "_Nb", "_Nc", "_max_b", *[c.alias(f"_e{k}") for k, c in enumerate([F.col("_min_b"), *deciles])]
    )
    e = [F.col(f"_e{k}") for k in range(len(deciles) + 1)]
    inside = functools.reduce(
        operator.add,
        [F.when((e[k] <= v) & ((e[k] != e[k - 1]) if k else F.lit(True)), 1).otherwise(0) for k in range(len(e))],
    )
    shares = (
        pair(counts.where(v.isNotNull()))
        .join(edges, keys)
        .select(
            *keys,
            F.when(v < e[0], F.lit(-1)).when(v > F.col("_max_b"), F.lit(1 << 20)).otherwise(inside).alias("_bin"),
            "_is_b",
            "n",
            "_Nb",
            "_Nc",
        )
        .groupBy(*keys, "_bin")
        .agg(
            F.try_divide(total("n", True), F.first("_Nb")).alias("p_b"),
            F.try_divide(total("n", False), F.first("_Nc")).alias("p_c"),
        )
    )
    # a dozen bins a key, added in their order: the same sum however they were dealt
    terms = F.array_sort(F.collect_list(F.struct("_bin", jsd_term(F.col("p_b"), F.col("p_c")).alias("term"))))
    jsd = shares.groupBy(*keys).agg(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["term"]).alias("js_divergence"))
    out = dist.join(jsd, keys, "left")
    ok = (Nb > 0) & (Nc > 0)
    return out.select(
        *keys,
        Nb.alias("n_baseline"),
        Nc.alias("n_current"),
        (F.try_divide(F.col("_Tc") - Nc, F.col("_Tc")) - F.try_divide(F.col("_Tb") - Nb, F.col("_Tb"))).alias("null_rate_delta"),
        F.abs(F.col("_mean_c") - F.col("_mean_b")).alias("mean_drift"),
        F.when(ok, F.col("ks_stat")).alias("ks_stat"),
        F.when(ok, ks_p_value(F.col("ks_stat"), Nb.cast("double"), Nc.cast("double"))).alias("ks_p_value"),
        F.when(ok, F.col("wasserstein_distance")).alias("wasserstein_distance"),
        F.when(ok & (F.col("_sd_b") > 0), F.col("wasserstein_distance") / F.col("_sd_b")).alias("wasserstein_norm"),
        F.when(ok, F.col("js_divergence")).alias("js_divergence"),
        drift_status(F.col("_Tb"), F.col("_Tc")).alias("status"),
    )


def categorical_drift(paired: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Drift metrics per key for a categorical paired count frame (null is a category)."""
    keys = list(keys)
    v = F.col(value)
    stats = paired.groupBy(*keys).agg(
        F.sum("n_b").alias("_Tb"),
        F.sum("n_c").alias("_Tc"),
        F.sum(F.when(v.isNotNull(), F.col("n_b")).otherwise(0)).alias("_Nb"),
        F.sum(F.when(v.isNotNull(), F.col("n_c")).otherwise(0)).alias("_Nc"),
    )
    shares = paired.join(stats.select(*keys, "_Tb", "_Tc"), keys).select(
        *keys,
        F.try_divide(F.col("n_b"), F.col("_Tb")).alias("p_b"),
        F.try_divide(F.col("n_c"), F.col("_Tc")).alias("p_c"),
    )
    jsd = jsd_from_shares(shares, keys)
    ok = (F.col("_Tb") > 0) & (F.col("_Tc") > 0)
    nul = F.lit(None).cast("double")
    return stats.join(jsd, keys, "left").select(
        *keys,
        F.col("_Nb").alias("n_baseline"),
        F.col("_Nc").alias("n_current"),
        (F.try_divide(F.col("_Tc") - F.col("_Nc"), F.col("_Tc")) - F.try_divide(F.col("_Tb") - F.col("_Nb"), F.col("_Tb"))).alias(
            "null_rate_delta"
        ),
        nul.alias("mean_drift"),
        nul.alias("ks_stat"),
        nul.alias("ks_p_value"),
        nul.alias("wasserstein_distance"),
        nul.alias("wasserstein_norm"),
        F.when(ok, F.col("js_divergence")).alias("js_divergence"),
        drift_status(F.col("_Tb"), F.col("_Tc")).alias("status"),
    )
