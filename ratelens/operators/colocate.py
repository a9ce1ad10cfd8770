"""Key-range co-partitioning of a master table and its detail tables.

Split points are learnt once on the master key (approximate quantiles, the
only driver round-trip: ``num_buckets + 1`` numbers).  Every table, whatever
its own key column is called, gets the same integer bucket column from those
splits, and is written partitioned (one directory per bucket) or bucketed
(hash buckets in the catalog).  Joins that also equate the bucket column let
a filter on one side prune the other side's partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_KEY_POLICIES = ("error", "keep", "drop")


def validate_key(df: DataFrame, key: str, what: str = "master") -> None:
    """Key must exist (ValueError) and be numeric (TypeError)."""
    if key not in df.columns:
        raise ValueError(f"{what} join key column '{key}' not found; columns: {df.columns}")
    dtype = df.schema[key].dataType
    if not isinstance(dtype, T.NumericType):
        raise TypeError(f"{what} join key column '{key}' must be numeric, found {dtype.simpleString()}")


def learn_splits(df: DataFrame, key: str, num_buckets: int = 10, relative_error: float = 0.001) -> list[float]:
    """Open-ended split points ``[-inf, s1, ..., sk, +inf]`` from approximate quantiles.

    ``num_buckets`` is an upper bound: duplicate quantiles collapse, so a
    skewed key can give fewer buckets (``len(splits) - 1`` is the real count).
    """
    validate_key(df, key)
    model = QuantileDiscretizer(
        numBuckets=num_buckets,
        inputCol=key,
        outputCol="_bucket",
        relativeError=relative_error,
        handleInvalid="error",
    ).fit(df.select(key))
    inner = model.getSplits()[1:-1]
    return [float("-inf"), *inner, float("inf")]


def bucket_expr(key: str | Column, splits: Sequence[float], null_keys: str = "error") -> Column:
    """Integer bucket of ``key``: bucket i covers ``[splits[i], splits[i+1])``.

    The inner split points are a literal array in the plan, so the bucket is
    a codegen'd expression (no UDF).  NaN keys raise; null keys follow
    ``null_keys``: ``"keep"`` -> null bucket, ``"error"`` -> raise
    (``"drop"`` is applied as a filter by :func:`assign_bucket`).
    """
    if null_keys not in NULL_KEY_POLICIES:
        raise ValueError(f"null_keys must be one of {NULL_KEY_POLICIES}")
    k = F.col(key) if isinstance(key, str) else key
    kd = k.cast("double")
    inner = F.array(*[F.lit(float(s)) for s in splits[1:-1]])
    b = F.size(F.filter(inner, lambda s: s <= kd)).cast("int")
    out = F.when(F.isnan(kd), F.raise_error(F.lit("NaN join key cannot be bucketed")))
    if null_keys == "error":
        out = out.when(k.isNull(), F.raise_error(F.lit("null join key cannot be bucketed (null_keys='error')")))
    return out.when(k.isNotNull(), b)


def assign_bucket(
    df: DataFrame, key: str, splits: Sequence[float], out_col: str = "partition_key", null_keys: str = "error"
) -> DataFrame:
    src = df.where(F.col(key).isNotNull()) if null_keys == "drop" else df
    return src.withColumn(out_col, bucket_expr(key, splits, "keep" if null_keys == "drop" else null_keys))


@dataclass
class CoPartitioned:
    splits: list[float]
    paths: dict[str, str] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def num_buckets(self) -> int:
        return len(self.splits) - 1


def plan_copartitioned(
    master: DataFrame,
    master_key: str,
    details: Sequence[tuple[DataFrame, str]],
    num_buckets: int = 10,
    partition_key_col: str = "partition_key",
    null_keys: str = "error",
    splits: Sequence[float] | None = None,
) -> CoPartitioned:
    """Learn splits (unless given) and bucket every table (lazy; nothing written).

    Details whose key column is missing are skipped and listed in ``skipped``.
    """
    validate_key(master, master_key)
    sp = list(splits) if splits is not None else learn_splits(master, master_key, num_buckets)
    res = CoPartitioned(splits=sp)
    res.frames["master"] = assign_bucket(master, master_key, sp, partition_key_col, null_keys)
    res.keys["master"] = master_key
    for i, (d, key) in enumerate(details):
        ident = f"detail_{i}"
        if key not in d.columns:
            res.skipped.append(ident)
            continue
        validate_key(d, key, ident)
        res.frames[ident] = assign_bucket(d, key, sp, partition_key_col, null_keys)
        res.keys[ident] = key
    return res


def write_copartitioned(
    plan: CoPartitioned,
    output_base_path: str,
    partition_key_col: str = "partition_key",
    layout: str = "partitioned",
    fmt: str = "parquet",
    files_per_bucket: int | None = None,
    hash_buckets: int | None = None,
    table_prefix: str = "copart",
) -> CoPartitioned:
    """Write every planned table; fills ``plan.paths``.  Errors propagate.

    ``partitioned``: one directory per bucket.  Rows are shuffled on
    ``(bucket, hash(row) mod files_per_bucket)`` - the salt is a
    deterministic row hash, so a retried task rebuilds the same files - which
    spreads every bucket, including one holding a third of the rows, over
    many write tasks; each task writes about one file per bucket it holds.
    ``files_per_bucket`` defaults to ``spark.sql.shuffle.partitions``, and
    AQE may coalesce small shuffle partitions.  The overwrite is static: a
    rewrite with fewer buckets leaves no stale directory.

    ``bucketed``: ``bucketBy(hash_buckets, key).sortBy(key)`` tables in the
    session catalog at the same paths (default ``hash_buckets`` =
    ``spark.sql.shuffle.partitions``); joins between them on the keys plan
    without an Exchange.  Keys are cast to the master key type so their
    hashes agree.  A key value holding a large share of the rows makes one
    large hash bucket; prefer the partitioned layout (whose joins keep AQE's
    skew handling) for such keys.
    """
    if layout not in ("partitioned", "bucketed"):
        raise ValueError("layout must be 'partitioned' or 'bucketed'")
    master = plan.frames["master"]
    parallelism = int(master.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    master_type = master.schema[plan.keys["master"]].dataType
    for ident, df in plan.frames.items():
        path = f"{output_base_path.rstrip('/')}/{ident}_partitioned"
        if layout == "partitioned":
            k = files_per_bucket or parallelism
            salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(k))
            (
                df.repartition(F.col(partition_key_col), salt)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "static")
                .partitionBy(partition_key_col)
                .format(fmt)
                .save(path)
            )
        else:
            key = plan.keys[ident]
            n = hash_buckets or parallelism
            out = df.withColumn(key, F.col(key).cast(master_type)).repartition(n, F.col(key))
            (
                out.write.mode("overwrite")
                .bucketBy(n, key)
                .sortBy(key)
                .format(fmt)
                .option("path", path)
                .saveAsTable(f"{table_prefix}_{ident}")
            )
        plan.paths[ident] = path
    return plan


def save_bucketed(df: DataFrame, key: str, table: str, path: str, buckets: int | None = None) -> None:
    """``df`` as a catalog table in hash buckets of its key (default: ``spark.sql.shuffle.partitions``), sorted by it.

    Rows are dealt by (key's bucket, hash of the row) before the write, so the
    rows of a hot key are written by many tasks; a bucket may have several files.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(n))
    bucket = F.pmod(F.hash(key), F.lit(n))
    out = df.repartition(n, bucket, salt)
    out.write.mode("overwrite").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)


def create_partitioned_tables(
    master: DataFrame,
    master_key: str,
    details: Sequence[tuple[DataFrame, str]],
    num_buckets: int,
    output_base_path: str,
    partition_key_col: str = "partition_key",
    layout: str = "partitioned",
    null_keys: str = "error",
    fmt: str = "parquet",
    hash_buckets: int | None = None,
) -> CoPartitioned:
    """Learn splits on the master key, bucket master and details, write them."""
    plan = plan_copartitioned(master, master_key, details, num_buckets, partition_key_col, null_keys)
    return write_copartitioned(plan, output_base_path, partition_key_col, layout, fmt, hash_buckets=hash_buckets)


def join_copartitioned(
    master: DataFrame,
    detail: DataFrame,
    master_key: str,
    detail_key: str,
    partition_key_col: str = "partition_key",
    detail_columns: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """``master.key == detail.key`` joined with ``pk == pk`` added.

    Equal keys always share a bucket, so the extra equality changes no
    result; it lets partition filters on one side reach the other.  Returns
    ``m.*`` plus ``detail_columns`` (all detail columns but the key and the
    bucket when None).
    """
    m, d = master.alias("m"), detail.alias("d")
    cond = (F.col(f"m.{master_key}") == F.col(f"d.{detail_key}")) & (
        F.col(f"m.{partition_key_col}") == F.col(f"d.{partition_key_col}")
    )
    if detail_columns is None:
        detail_columns = [c for c in detail.columns if c not in (detail_key, partition_key_col)]
    return m.join(d, cond, how).select("m.*", *[F.col(f"d.{c}") for c in detail_columns])


def bucket_report(df: DataFrame, key: str, partition_key_col: str = "partition_key") -> DataFrame:
    """Rows and key range per bucket."""
    return df.groupBy(partition_key_col).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(key).alias("min_key"), F.max(key).alias("max_key")
    )
