"""Lineage cuts for multi-consumer intermediate results.

A monitor's value-count frame feeds a dozen downstream aggregates; left as
lineage, every consumer drags the whole upstream plan (and, for the
separate-table layout, a union over every monthly table) through the
optimizer again.  ``materialize`` writes it once to the cluster's reliable
checkpoint directory (``spark.checkpoint.dir``), so downstream plans start
from a small file scan and a lost executor costs a re-read, not a
recomputation.  Without a configured directory it falls back to ``persist``
(memory, spilling to disk; recomputed from lineage on loss).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Where none is set, a local session (tests, one machine) gets a folder of
    its own; on a cluster a machine-local folder would lose data, so that
    raises a ValueError.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="ratelens-shared-")
        sc.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for results that several plans read.

    Unlike a checkpoint the table keeps column pruning, filters and sizes, so
    later joins are planned from its real size; a lost executor costs a re-read.
    """
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_dir(df: DataFrame) -> str | None:
    """The session's reliable checkpoint directory, if any."""
    spark = df.sparkSession
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - Spark Connect has no SparkContext
        return None


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` (eager reliable checkpoint, else persist)."""
    if checkpoint_dir(df):
        sc = df.sparkSession.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
        return df.checkpoint(eager=True)
    return df.persist()
