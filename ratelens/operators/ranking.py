"""Distributed ordering operators: prefix sums, global rank tiles, exact quantiles.

``Window.orderBy(x)`` without a partition puts every row into one task
(``Exchange SinglePartition``).  Two plans avoid that, whatever the size:

* **Order statistics without ordering** (``order_statistics``), for quantiles
  and tiles of one column.  A first aggregate gives approximate quantiles a
  little below and above every wanted rank; a second counts the rows below and
  between them, which proves or moves the bracket.  A bracket that still holds
  many rows is split again by approximate quantiles of its own rows, and so on;
  what is left of one is at most ``LEAF_ROWS`` values.  Every pass is one
  map-side combined aggregate over one stored column; no row is shuffled, and
  ranks come out exact.
* **Prefix sums** (``ordered_prefix``), for cumulative distributions.  Rows are
  first counted per ``(keys, value)``, so ties and hot values are one row.
  Spark's range partitioning on ``(keys, value)`` (sampled borders, binary
  search) deals these rows evenly; per-partition totals give every partition
  its offset, and a running sum inside ``(keys, partition)`` the rest.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.lineage import materialize, stored

#: Rank accuracy of the approximate quantiles that bracket a rank (a fraction of 1 / ACCURACY).
ACCURACY = 10_000
#: A bracket of at most so many rows is resolved by its values themselves.
LEAF_ROWS = 10_000


def _valued(df: DataFrame, value: str) -> Column:
    """Rows with a value: not null, not NaN."""
    known = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        known = known & ~F.isnan(value)
    return known


def order_statistics(col: DataFrame, value: str, total: int, ranks: Sequence[int], leaf_rows: int = LEAF_ROWS) -> dict[int, object]:
    """rank -> value, for 0-based ``ranks`` of the ``total`` non-null rows of a stored column.

    The driver holds one bracket a rank, and in the end the values of at most
    ``leaf_rows`` rows of each.
    """
    x, typ = F.col(value), col.schema[value].dataType

    def lit(v: object) -> Column:
        return F.lit(v).cast(typ)

    ranks = sorted(set(ranks))
    if not ranks:
        return {}
    found: dict[int, object] = {}
    # rank -> (low, high, rows, below): its value lies strictly between low and high (None: no bound), as do ``rows`` rows
    open_: dict[int, tuple] = {r: (None, None, total, 0) for r in ranks}

    def inside(low: object, high: object) -> Column:
        conds = ([x > lit(low)] if low is not None else []) + ([x < lit(high)] if high is not None else [])
        return functools.reduce(operator.and_, conds, F.lit(True))

    while open_:
        large = {r: b for r, b in open_.items() if b[2] > leaf_rows}
        if not large:
            break
        # approximate quantiles around each rank, over its bracket's rows
        groups = sorted({b[:4] for b in large.values()}, key=str)
        asks, wanted = [], {}
        for k, (low, high, rows, below) in enumerate(groups):
            mine = [r for r, b in large.items() if b[:4] == (low, high, rows, below)]
            probs = sorted({min(1.0, max(0.0, (r - below) / rows + d)) for r in mine for d in (-2 / ACCURACY, 2 / ACCURACY)})
            asks.append(F.percentile_approx(F.when(inside(low, high), x), probs, ACCURACY).alias(f"q{k}"))
            for r in mine:
                wanted[r] = (k, [probs.index(min(1.0, max(0.0, (r - below) / rows + d))) for d in (-2 / ACCURACY, 2 / ACCURACY)])
        quant = col.agg(*asks).first()
        cuts = sorted({quant[k][i] for k, at in wanted.values() for i in at})
        # one pass counts all rows by the cuts: below, at and above each
        count = col.agg(
            *[F.sum(F.when(x < lit(c), 1).otherwise(0)).alias(f"l{i}") for i, c in enumerate(cuts)],
            *[F.sum(F.when(x <= lit(c), 1).otherwise(0)).alias(f"u{i}") for i, c in enumerate(cuts)],
        ).first()
        under = {c: count[f"l{i}"] for i, c in enumerate(cuts)}
        upto = {c: count[f"u{i}"] for i, c in enumerate(cuts)}
        for r, (low, high, rows, below) in large.items():
            hit = next((c for c in cuts if under[c] <= r < upto[c]), None)
            if hit is not None:
                found[r] = hit
                del open_[r]
                continue
            # the nearest cuts around the rank; every cut is a value of the bracket, which so shrinks by at least that
            lows = [c for c in cuts if upto[c] <= r]
            highs = [c for c in cuts if under[c] > r]
            lo, hi = (lows[-1] if lows else low), (highs[0] if highs else high)
            base = upto[lo] if lo in upto else below
            end = under[hi] if hi in under else below + rows
            if (lo, hi) == (low, high):  # no cut came nearer
                raise RuntimeError(f"rank {r} of {value} not found; the column changed between passes")
            open_[r] = (lo, hi, end - base, base)
    if open_:
        near = functools.reduce(operator.or_, [inside(low, high) for low, high, _, _ in set(open_.values())])
        counts = sorted((row[0], row[1]) for row in col.where(near).groupBy(value).count().collect())
        for r, (low, high, _, below) in open_.items():
            at = below
            for v, n in counts:
                if (low is None or v > low) and (high is None or v < high):
                    at += n
                    if r < at:
                        found[r] = v
                        break
    return found


def _column(df: DataFrame, value: str, *more: Column) -> DataFrame:
    """The column's values, stored: every pass reads this table only."""
    return stored(df.where(_valued(df, value)).select(value, *more))


def _quantiles(col: DataFrame, value: str, total: int, probs: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles, defined as Spark's ``percentile``: position ``p * (N - 1)``."""
    if not total:
        return [None for _ in probs]
    at = [p * (total - 1) for p in probs]
    v = order_statistics(col, value, total, [r for q in at for r in (math.floor(q), math.ceil(q))])
    out = []
    for q in at:
        lo, hi = float(v[math.floor(q)]), float(v[math.ceil(q)])
        out.append(lo if lo == hi else (math.ceil(q) - q) * lo + (q - math.floor(q)) * hi)
    return out


def _doubles(values: Sequence[float | None]) -> Column:
    return F.array(*[F.lit(v).cast("double") for v in values])


def ordered_prefix(
    vc: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Inclusive running sums of ``measures`` in ``value`` order within ``keys``.

    ``vc`` must hold one row per ``(keys, value)`` (distinct, non-null values).
    Adds ``cum_<m>`` (running sum) and ``tot_<m>`` (group total) for each
    measure and ``next_value`` (the next larger value in the group, null for
    the largest).  ``partitions``: range partitions, by default the session's
    shuffle partitions.  No window sees more than one of them.
    """
    keys = list(keys)
    parts = partitions or int(vc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partition ids must not change between the two reads below
    ranged = stored(vc.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()))
    tot = ranged.groupBy(*keys, "_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures], F.min(value).alias("_least"))
    across = Window.partitionBy(*keys).orderBy("_part")
    whole = Window.partitionBy(*keys)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(whole).alias(f"tot_{m}") for m in measures],
        F.lead("_least").over(across).alias("_next_least"),
    )
    w = Window.partitionBy(*keys, "_part").orderBy(value)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(offs, [*keys, "_part"]).select(
        *vc.columns,
        *[(F.col(f"_o_{m}") + F.sum(m).over(running)).alias(f"cum_{m}") for m in measures],
        *[F.col(f"tot_{m}") for m in measures],
        F.coalesce(F.lead(value).over(w), F.col("_next_least")).alias("next_value"),
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, count_name: str = "n") -> DataFrame:
    """One row per non-null ``(keys, value)`` with its row count (NaN dropped too)."""
    return df.where(_valued(df, value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count_name))


def quantiles_from_prefix(
    pre: DataFrame,
    keys: Sequence[str],
    value: str,
    n: str,
    cum: str,
    probs: Sequence[float],
    name: str = "quantiles",
) -> DataFrame:
    """Exact interpolated quantiles from a prefix-sum frame.

    Same definition as Spark's ``percentile``: position ``p * (N - 1)``,
    linear interpolation between the values at its floor and ceiling ranks.
    Returns ``keys + [name]`` where ``name`` is an array aligned with
    ``probs``.  Groups with no values are absent (keyed) or give an array of
    nulls (global).
    """
    keys = list(keys)
    x = pre.where(F.col(n) > 0).withColumn("_N", F.col(f"tot_{n}"))
    start = F.col(cum) - F.col(n)  # 0-based rank of the value's first row
    pos = [F.lit(float(p)) * (F.col("_N") - 1) for p in probs]

    def covers(rank: Column) -> Column:
        return (rank >= start) & (rank < F.col(cum))

    # plain comparisons first (codegen'd): keeps at most 2 rows per probability
    x = x.where(functools.reduce(operator.or_, [covers(F.floor(q)) | covers(F.ceil(q)) for q in pos]))
    targets = F.array(
        *[F.struct(F.lit(i).alias("i"), q.alias("pos"), F.floor(q).alias("lo"), F.ceil(q).alias("hi")) for i, q in enumerate(pos)]
    )
    hits = x.select(
        *keys,
        F.col(value).cast("double").alias("_v"),
        F.explode(F.filter(targets, lambda t: covers(t["lo"]) | covers(t["hi"]))).alias("t"),
        start.alias("_s"),
        F.col(cum).alias("_e"),
    )
    in_lo = (F.col("t.lo") >= F.col("_s")) & (F.col("t.lo") < F.col("_e"))
    in_hi = (F.col("t.hi") >= F.col("_s")) & (F.col("t.hi") < F.col("_e"))
    per_p = hits.groupBy(*keys, F.col("t.i").alias("i")).agg(
        F.first("t.pos").alias("pos"),
        F.max(F.when(in_lo, F.col("_v"))).alias("v_lo"),
        F.max(F.when(in_hi, F.col("_v"))).alias("v_hi"),
    )
    lo, hi, pos = F.floor("pos"), F.ceil("pos"), F.col("pos")
    q = F.when((lo == hi) | (F.col("v_lo") == F.col("v_hi")), F.col("v_lo")).otherwise(
        (hi - pos) * F.col("v_lo") + (pos - lo) * F.col("v_hi")
    )
    per_p = per_p.select(*keys, "i", q.alias("q"))
    agg = F.collect_list(F.struct("i", "q"))
    if keys:
        out = per_p.groupBy(*keys).agg(agg.alias("_qs"))
    else:
        out = per_p.agg(agg.alias("_qs"))
    lookup = F.map_from_entries(F.col("_qs"))
    return out.select(*keys, F.array(*[lookup[F.lit(i)] for i in range(len(probs))]).alias(name))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    name: str = "quantiles",
    partitions: int | None = None,
) -> DataFrame:
    """Exact ``percentile(value, probs)``, without one big buffer.

    ``percentile`` keeps one count per distinct value in a single aggregation
    buffer; for a billion amounts that is one task holding every distinct
    value.  Here a column's quantiles are order statistics (see module doc);
    with ``keys`` they come from one prefix sum over all groups.
    """
    keys = list(keys)
    if keys:
        pre = ordered_prefix(value_counts(df, keys, value), keys, value, ["n"], partitions)
        return quantiles_from_prefix(pre, keys, value, "n", "cum_n", probs, name)
    col = _column(df, value)
    qs = _quantiles(col, value, col.count(), probs)
    return df.sparkSession.range(1).select(_doubles(qs).alias(name))


def tile_ranks(total: int, tiles: int) -> list[int]:
    """First 0-based rank of each tile that holds rows: the first ``total mod tiles`` tiles hold one row more."""
    base, more = divmod(total, tiles)
    starts = [d * base + min(d, more) for d in range(tiles)]
    return [s for s in starts if s < total][: min(tiles, total)]


def ntile_summary(
    df: DataFrame,
    value: str,
    tiles: int = 10,
    tile_name: str = "tile",
    sum_scale: int | None = None,
    counted: str | None = None,
) -> DataFrame:
    """Per-tile ``count, min, max, sum`` of ``ntile(tiles) OVER (ORDER BY value)``.

    The values at the tiles' first ranks are found as order statistics.  One
    aggregate then sums the rows between and at these values; a run of equal
    values that straddles a tile's border is split arithmetically between the
    tiles (all its rows have the same value, so min/max/sum per tile are what
    the per-row window would give).

    Returns ``[tile_name, n_rows, min_value, max_value, sum_value]``;
    ``sum_value`` is a double sum, or exact (``decimal`` arithmetic, cast to
    double) for values of at most ``sum_scale`` decimals when that is given.
    ``counted``: also ``n_counted``, the tile's rows with a non-null value of
    that column; of equal values, those rows are taken to come first.
    """
    has = F.lit(1) if counted is None else F.when(F.col(counted).isNotNull(), 1).otherwise(0)
    col = _column(df, value, has.alias("_has"))
    total = col.count()
    starts = tile_ranks(total, tiles)
    at = order_statistics(col, value, total, starts[1:])
    borders = sorted(set(at.values()))
    x, typ = F.col(value), col.schema[value].dataType

    # segment 2k: between borders, 2k + 1: at border k
    segment = F.lit(0)
    for b in borders:
        v = F.lit(b).cast(typ)
        segment = segment + F.when(x > v, 2).when(x == v, 1).otherwise(0)
    amount = x if sum_scale is None else x.cast(T.DecimalType(18, sum_scale))
    segs = col.groupBy(segment.alias("_seg")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_has").alias("_k"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.sum(amount).alias("_sum")
    )
    # at most 2 * tiles rows from here on
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ends = [*starts[1:], total]
    tile = F.explode(
        F.array(*[F.struct(F.lit(d + 1).alias("t"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for d, (s, e) in enumerate(zip(starts, ends))])
        if starts
        else F.array().cast("array<struct<t:int,s:long,e:long>>")
    )
    t = segs.select("*", tile.alias("_tile"))
    lo, hi = F.greatest("_s", "_tile.s"), F.least(F.col("_s") + F.col("_n"), F.col("_tile.e"))
    n = hi - lo
    t = t.withColumn("_rows", n).where("_rows > 0")
    one_value = F.col("_seg") % 2 == 1
    if sum_scale is None:
        part = F.when(one_value, F.col("_lo") * F.col("_rows")).otherwise(F.col("_sum"))
        total_sum = F.sum(part)
    else:
        tied = F.col("_lo").cast(T.DecimalType(18, sum_scale)) * F.col("_rows").cast(T.DecimalType(18, 0))
        total_sum = F.sum(F.when(one_value, tied).otherwise(F.col("_sum").cast(T.DecimalType(37, sum_scale)))).cast("double")
    with_value = F.greatest(F.least(F.col("_s") + F.col("_k"), hi) - lo, F.lit(0))
    return t.groupBy(F.col("_tile.t").alias(tile_name)).agg(
        F.sum("_rows").alias("n_rows"),
        F.min("_lo").alias("min_value"),
        F.max("_hi").alias("max_value"),
        total_sum.alias("sum_value"),
        *([F.sum(F.when(one_value, with_value).otherwise(F.col("_k"))).alias("n_counted")] if counted else []),
    )


def distribution_stats(
    df: DataFrame, value: str, probs: Sequence[float], sum_scale: int | None = None, name: str = "quantiles"
) -> DataFrame:
    """One row: ``min, max, mean, stddev`` and exact quantiles of ``value``.

    One stored column, one aggregate and the order statistics' passes.  The
    mean is an exact sum (``decimal(18, sum_scale)`` for amounts) where
    ``sum_scale`` is given.
    """
    col = _column(df, value)
    v = F.col(value)
    total = F.sum(v) if sum_scale is None else F.sum(v.cast(T.DecimalType(18, sum_scale))).cast("double")
    row = col.agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.try_divide(total, F.count(v)).alias("mean"), F.stddev_samp(v).alias("stddev"), F.count(v).alias("n")
    )
    row = materialize(row)
    qs = _quantiles(col, value, row.first()["n"], probs)
    return row.select("min", "max", "mean", "stddev", _doubles(qs).alias(name))
