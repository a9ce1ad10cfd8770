"""Long-form value counts and the profile metrics table.

``long_value_counts`` is the one heavy step of every monitor: each input row
becomes one row per monitored column (``inline`` over an array of structs,
a single Generate inside the scan's codegen stage), then a hash aggregation
counts rows per ``(window, slice, column, value)``.  Spark's partial
aggregation runs before the shuffle, so low-cardinality columns shrink to a
handful of rows per task, and a hot value (a third of all rows) is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.columns import as_number
from ratelens.functions.lineage import stored
from ratelens.operators.ranking import ordered_prefix, quantiles_from_prefix

ALL_SLICE = "all"
PROFILE_PROBS = [0.25, 0.5, 0.75]


def slice_column(slices: Sequence[str] | None) -> Column:
    """Array of the slice ids a row belongs to: always 0 (``"all"``), plus
    ``i`` for every slicing predicate ``slices[i-1]`` (SQL text) that holds."""
    ids = [F.lit(0)] + [F.when(F.expr(s), F.lit(i)) for i, s in enumerate(slices or [], start=1)]
    return F.filter(F.array(*ids), lambda x: x.isNotNull())


class Layout:
    """Integer codes of the monitored columns and slices.

    Aggregations and sorts run on one ``long`` group key that packs the
    window (days since epoch), the slice id and the column id; names are
    decoded only on the final, small result.
    """

    SLICE_BITS, COL_BITS = 10, 16
    #: Day of rows without a window (null timestamp); past every date Spark can write.
    NO_WINDOW = 1 << 22

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], slices: Sequence[str] | None):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.columns = self.numeric + self.categorical
        self.slices = [ALL_SLICE, *(slices or [])]
        if len(self.slices) >= 1 << self.SLICE_BITS or len(self.columns) >= 1 << self.COL_BITS:
            raise ValueError("too many slices or columns for one monitor pass")

    def window_key(self, window: Column) -> Column:
        day = F.coalesce(F.unix_date(window), F.lit(self.NO_WINDOW)).cast("long")
        return day * (1 << (self.SLICE_BITS + self.COL_BITS))

    def column_id(self, g: str) -> Column:
        return F.pmod(F.col(g), F.lit(1 << self.COL_BITS)).cast("int")

    def series(self, g: str) -> Column:
        """A key without its window: the slice and the column."""
        return F.col(g).bitwiseAND((1 << (self.SLICE_BITS + self.COL_BITS)) - 1).alias("_series")

    def day(self, g: str) -> Column:
        # an arithmetic shift: windows before 1970 give negative keys
        return F.shiftright(F.col(g), self.SLICE_BITS + self.COL_BITS).cast("int")

    def at_day(self, g: str, day: Column) -> Column:
        """The key of the same slice and column at another day (null: no window)."""
        return self.window_key(F.date_from_unix_date(day)) + self.series(g)

    def decode(self, g: str = "_g") -> dict[str, Column]:
        # pmod, not %: windows before 1970 give negative keys
        col_id = self.column_id(g)
        slice_id = F.pmod(F.floor(F.col(g) / (1 << self.COL_BITS)), F.lit(1 << self.SLICE_BITS)).cast("int")
        day = self.day(g)
        return {
            "window_start": F.when(day != self.NO_WINDOW, F.date_from_unix_date(day)),
            "slice": F.element_at(F.array(*[F.lit(s) for s in self.slices]), slice_id + 1),
            "column_name": F.element_at(F.array(*[F.lit(c) for c in self.columns]), col_id + 1),
        }


def long_value_counts(
    df: DataFrame,
    window: Column,
    layout: Layout,
    group_cols: Sequence[str] = (),
    sample: Sequence[str] = (),
    slices_col: str | None = None,
    single_scan: bool = False,
) -> DataFrame:
    """``(_g, [_groups], [sample...], col_id, num, cat, n)``: rows per distinct value.

    ``_g`` is the layout's key of window, slice and column, so the counting
    hashes one ``long`` and the value; ``_groups`` holds ``group_cols``.
    Numeric columns carry their value in ``num`` (NaN counted as null, dates and
    timestamps as days since 1970),
    categorical ones in ``cat`` (as string).  Slice ids come from the layout's
    predicates over ``df``, or from an array column ``slices_col`` built
    earlier with :func:`slice_column`.  Numeric and categorical columns are
    counted in two aggregations, so the numeric one (nearly all the rows of a
    ratemaking table) hashes fixed-width keys only.  That reads ``df`` twice;
    ``single_scan=True`` (for expensive inputs such as a union of monthly
    tables) counts both kinds in one aggregation over one read.
    """
    if not layout.columns:
        raise ValueError("no column to monitor")
    packed, groups = group_keys(group_cols)
    slices = layout.slices[1:]
    holds = [] if slices_col else [F.expr(p).alias(f"_slice{i}") for i, p in enumerate(slices, start=1)]
    base = df.select(
        layout.window_key(window).alias("_w"),
        *groups,
        *sample,
        *([F.explode(slices_col).alias("slice_id")] if slices_col else holds),
        *[as_number(df, c).alias(c) for c in layout.numeric],
        *layout.categorical,
    )
    if not slices_col:
        # plain comparisons, not an array built for every row
        base = base.withColumn("slice_id", F.explode(F.array(*[F.lit(i) for i in range(len(holds) + 1)])) if holds else F.lit(0))
        member = F.col("slice_id") == 0
        for i in range(1, len(holds) + 1):
            member = member | ((F.col("slice_id") == i) & F.col(f"_slice{i}"))
        base = base.where(member)
    base = base.withColumn("_w", F.col("_w") + F.col("slice_id") * F.lit(1 << layout.COL_BITS))
    keys = [*packed, *sample]
    rest = keys[1:]
    key = (F.col("_w") + F.col("col_id")).alias("_g")
    count = F.count(F.lit(1)).alias("n")
    col_id = layout.column_id("_g").alias("col_id")
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    if single_scan and layout.numeric and layout.categorical:
        items = [
            F.struct(F.lit(i).alias("col_id"), F.col(c).alias("num"), none_s.alias("cat"))
            for i, c in enumerate(layout.numeric)
        ] + [
            F.struct(F.lit(len(layout.numeric) + i).alias("col_id"), none_d.alias("num"), F.col(c).cast("string").alias("cat"))
            for i, c in enumerate(layout.categorical)
        ]
        long = base.select("_w", *rest, F.inline(F.array(*items))).select(key, *rest, "num", "cat")
        return long.groupBy(*keys, "num", "cat").agg(count).select(*keys, col_id, "num", "cat", "n")
    parts = []
    if layout.numeric:
        items = [
            F.struct(F.lit(i).alias("col_id"), F.col(c).alias("num"))
            for i, c in enumerate(layout.numeric)
        ]
        parts.append(
            base.select("_w", *rest, F.inline(F.array(*items)))
            .select(key, *rest, "num")
            .groupBy(*keys, "num")
            .agg(count)
            .withColumn("cat", none_s)
        )
    if layout.categorical:
        off = len(layout.numeric)
        items = [F.struct(F.lit(off + i).alias("col_id"), F.col(c).cast("string").alias("cat")) for i, c in enumerate(layout.categorical)]
        parts.append(
            base.select("_w", *rest, F.inline(F.array(*items)))
            .select(key, *rest, "cat")
            .groupBy(*keys, "cat")
            .agg(count)
            .withColumn("num", none_d)
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*keys, col_id, "num", "cat", "n")


def weighted_total(value: Column, weight: Column, scale: int | None = None) -> Column:
    """Sum of ``value`` repeated ``weight`` times; with ``scale`` an exact decimal (see :func:`weighted_mean`)."""
    if scale is None:
        return F.sum(value * weight)
    return F.sum(value.cast(T.DecimalType(18, scale)) * weight.cast(T.DecimalType(20, 0)))


def weighted_mean(value: Column, weight: Column, scale: int | None = None) -> Column:
    """Mean of ``value`` repeated ``weight`` times (nulls ignored).

    With ``scale`` the sum is exact ``decimal(18, scale)`` arithmetic (for
    amounts and rates with at most ``scale`` decimals), so the mean does not
    depend on summation order; otherwise a double sum.
    """
    w = F.when(value.isNotNull(), weight)
    return F.try_divide(weighted_total(value, weight, scale).cast("double"), F.sum(w))


def group_keys(groups: Sequence[str]) -> tuple[list[str], list[Column]]:
    """Key columns of a monitor, and the select list for its group columns.

    Groups are packed in one struct: a struct with a null field equals its
    like in joins, so a null group meets itself.
    """
    return (["_g", "_groups"], [F.struct(*groups).alias("_groups")]) if groups else (["_g"], [])


def profile_from_counts(
    vc: DataFrame,
    layout: Layout,
    window: str = "window_start",
    buckets: int | None = None,
    mean_scale: int | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Profile metrics per ``(window, slice, [groups], column)`` from long value counts."""
    groups = list(group_cols)
    keys, _ = group_keys(groups)
    is_num = F.col("col_id") < len(layout.numeric)
    num = vc.where(is_num).select(*keys, F.col("num").alias("value"), "n")
    cat = vc.where(~is_num).select(*keys, F.col("cat").alias("value"), "n")
    nd = F.lit(None).cast("double")

    def counts() -> list[Column]:
        v = F.col("value")
        return [
            F.sum("n").alias("row_count"),
            F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("null_count"),
            F.count(v).alias("distinct_count"),
        ]

    nstats = num.groupBy(*keys).agg(
        *counts(),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        weighted_mean(F.col("value"), F.col("n"), mean_scale).alias("mean"),
    )
    vals = num.where(F.col("value").isNotNull())
    # the value total rides along, so the spread is one aggregate around the mean
    vals = vals.withColumn("_vn", F.col("value") * F.col("n"))
    pre = stored(ordered_prefix(vals, keys, "value", ["n", "_vn"], buckets))
    off = F.col("value") - F.try_divide(F.col("tot__vn"), F.col("tot_n"))
    spread = pre.groupBy(*keys).agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * off * off), F.first("tot_n") - 1)).alias("stddev")
    )
    qs = quantiles_from_prefix(pre, keys, "value", "n", "cum_n", PROFILE_PROBS, name="_q")
    nprof = (
        nstats.join(spread, keys, "left")
        .join(qs, keys, "left")
        .select(
            *keys,
            F.lit("numeric").alias("data_type"),
            "row_count",
            "null_count",
            "distinct_count",
            "min_value",
            "max_value",
            "mean",
            "stddev",
            *[F.col("_q")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75"])],
        )
    )
    cprof = cat.groupBy(*keys).agg(*counts()).select(
        *keys,
        F.lit("categorical").alias("data_type"),
        "row_count",
        "null_count",
        "distinct_count",
        *[nd.alias(n) for n in ["min_value", "max_value", "mean", "stddev", "p25", "p50", "p75"]],
    )
    out = nprof.unionByName(cprof)
    names = layout.decode()
    return out.select(
        names["window_start"].alias(window),
        names["slice"].alias("slice"),
        *[F.col("_groups").getField(c).alias(c) for c in groups],
        names["column_name"].alias("column_name"),
        *[c for c in out.columns if c not in keys],
        (F.col("null_count") / F.col("row_count")).alias("null_rate"),
    )
