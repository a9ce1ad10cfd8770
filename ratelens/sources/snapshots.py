"""Monthly snapshot tables: load stamping, baseline capture, as-of reads, retention.

A store is one Parquet table partitioned by ``(year, month)``.  A capture
overwrites its month's directory, so writing April leaves March in place, and
re-capturing a month replaces only that month, also when no rows are left.  An
as-of read first asks the partition columns for the month (a small job), and
then filters to it, so only that partition is read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.sources.tables import read_source


def stamp_load_date(df: DataFrame, load_date: dt.datetime | str | None = None) -> DataFrame:
    """Add ``load_date`` (now, or the given time) and ``year`` / ``month`` from it."""
    ts = F.current_timestamp() if load_date is None else F.lit(load_date).cast("timestamp")
    return df.withColumn("load_date", ts).withColumns(
        {"year": F.year("load_date"), "month": F.month("load_date")}
    )


def monthly_table_name(name: str, year: int, month: int) -> str:
    """Name of the separate table of one month: ``<name>_<yyyy>_<mm>``."""
    return f"{name}_{year:04d}_{month:02d}"


def resolve_monthly(spark: SparkSession, name: str, year: int, month: int, fmt: str = "parquet") -> DataFrame:
    """Read the separate table of one month (catalog name, or a path prefix)."""
    return read_source(spark, monthly_table_name(name, year, month), fmt)


def clustered_write(df: DataFrame, path: str, cols: list[str], num_files: int | None = None, fmt: str = "parquet") -> None:
    """Range-cluster rows on ``cols`` before writing, so Parquet row-group
    min/max statistics let later filters on those columns skip data."""
    n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).write.mode("overwrite").format(fmt).save(path)


class SnapshotStore:
    """Monthly snapshots of a table under ``path``, partitioned by year/month."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt

    def capture(self, df: DataFrame, year: int, month: int) -> None:
        """Store ``df`` as the snapshot of ``(year, month)``.

        A table that already carries ``year``/``month`` columns is filtered
        to that month (baseline of one partition); otherwise the whole table
        is stored under the month (baseline before a truncate-and-overwrite).
        """
        if "year" in df.columns and "month" in df.columns:
            df = df.where((F.col("year") == year) & (F.col("month") == month)).drop("year", "month")
        df.write.mode("overwrite").format(self.fmt).save(f"{self.path}/year={year}/month={month}")

    def read(self) -> DataFrame:
        return self.spark.read.format(self.fmt).load(self.path)

    def month(self, year: int, month: int) -> DataFrame:
        """One month (static partition pruning)."""
        return self.read().where((F.col("year") == year) & (F.col("month") == month))

    def as_of(self, date: dt.date | str) -> DataFrame:
        """The latest snapshot whose month ended on or before ``date``; ValueError if there is none."""
        d = F.lit(date).cast("date")
        ym = F.col("year") * 100 + F.col("month")
        month_end = F.last_day(F.make_date(F.col("year"), F.col("month"), F.lit(1)))
        all_ = self.read()
        latest = all_.where(month_end <= d).agg(F.max(ym)).first()[0]
        if latest is None:
            raise ValueError(f"no snapshot ended on or before {date}")
        return all_.where(ym == latest)

    def list_snapshots(self, keep_days: int = 30, today: dt.date | str | None = None) -> DataFrame:
        """``(year, month, row_count, month_end, expired)`` per stored month.

        ``expired`` flags months whose end lies more than ``keep_days`` before
        ``today``; removing them is left to the caller.
        """
        t = F.current_date() if today is None else F.lit(today).cast("date")
        month_end = F.last_day(F.make_date(F.col("year"), F.col("month"), F.lit(1)))
        return (
            self.read()
            .groupBy("year", "month")
            .agg(F.count(F.lit(1)).alias("row_count"))
            .withColumn("month_end", month_end)
            .withColumn("expired", F.datediff(t, F.col("month_end")) > keep_days)
        )
