"""Inner joins whose keys are skewed, over stored tables.

A key is *heavy* if one side holds more of its rows than a fair task's share,
``rows / spark.sql.shuffle.partitions``; each side has fewer such keys than
shuffle partitions, whatever the data, so their table is broadcast.

* Light keys join as usual: without an Exchange if both tables are bucketed on
  the key.
* A heavy key's rows are dealt into a grid: each side into as many salts as it
  has fair shares, and every row meets all salts of the other side.  A key with
  a third of one side's rows so runs in a third of the tasks; the other side's
  rows are repeated once for each of them.

The salt hashes all columns, so a retried task deals the same rows; rows that
are equal in every column share a salt.  Null keys join with nothing; repeated
rows and ties join row by row, as in a plain join; an empty side gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.lineage import stored


def _salts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with more rows than a fair share: key, and how many salts they get."""
    share = max(1.0, df.count() / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).cast("int").alias(name))


def heavy_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Heavy keys of either side: key, left_salts, right_salts (1 where that side has no more than its share)."""
    typ = left.schema[left_key].dataType
    right = right.select(F.col(right_key).cast(typ).alias(right_key))
    both = _salts(left, left_key, "left_salts").join(_salts(right, right_key, "right_salts"), "key", "full")
    return stored(both.na.fill(1, ["left_salts", "right_salts"]))


def _free(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def _row_salt(df: DataFrame, salts: str) -> Column:
    columns = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(*columns), F.col(salts)).cast("int")


def join_heavy(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, right_columns: Sequence[str] | None = None
) -> DataFrame:
    """``left`` and ``right`` joined (inner) on their keys: left's columns and ``right_columns`` (None: all but the key)."""
    right_columns = list(right_columns) if right_columns is not None else [c for c in right.columns if c != right_key]
    right = right.select(right_key, *[c for c in right_columns if c != right_key])
    taken = [*left.columns, *right.columns]
    key, mine, other, i, j = (_free(n, taken) for n in ("heavy_key", "left_salts", "right_salts", "row_salt", "column_salt"))
    heavy = heavy_keys(left, right, left_key, right_key).toDF(key, mine, other)

    def out(a: DataFrame, b: DataFrame, *salts: str) -> DataFrame:
        m, d = a.alias("m"), b.alias("d")
        cond = F.col(f"m.{left_key}") == F.col(f"d.{right_key}")
        for s in salts:
            cond = cond & (F.col(f"m.{s}") == F.col(f"d.{s}"))
        return m.join(d, cond).select(*[F.col(f"m.{c}") for c in left.columns], *[F.col(f"d.{c}") for c in right_columns])

    def light(df: DataFrame, own: str) -> DataFrame:
        # bounded: fewer heavy keys than shuffle partitions on each side
        return df.join(F.broadcast(heavy), F.col(own) == F.col(key), "left_anti")

    def dealt(df: DataFrame, own: str, salts: str, salt: str, others: str, copy: str) -> DataFrame:
        found = df.join(F.broadcast(heavy), F.col(own) == F.col(key))
        copies = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        return found.withColumn(salt, _row_salt(df, salts)).withColumn(copy, copies).drop(key, salts, others)

    rare = out(light(left, left_key), light(right, right_key))
    grid = out(dealt(left, left_key, mine, i, other, j), dealt(right, right_key, other, j, mine, i), i, j)
    return rare.unionAll(grid)
