"""Table resolution: catalog names, Parquet paths, or a directory of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory laid out as ``<dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_source(spark: SparkSession, source: str | DataFrame, fmt: str = "parquet") -> DataFrame:
    """Accept a DataFrame, a catalog table name, or a path.

    A string with a path separator or a scheme is read with ``fmt``;
    anything else is looked up in the catalog.
    """
    if isinstance(source, DataFrame):
        return source
    if not source:
        raise ValueError("an empty table name cannot be resolved")
    if "/" in source or ":" in source:
        return spark.read.format(fmt).load(source)
    return spark.table(source)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Save a result as a catalog table (``saveAsTable``)."""
    df.write.mode(mode).format(fmt).saveAsTable(name)
