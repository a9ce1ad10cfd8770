"""Distributed connected components: alternating large-star and small-star.

Each round is two aggregations with joins over the edges; nothing goes to the
driver but one count and one sum.  Rounds grow with the logarithm of the
longest path.  Edges are written to the shared folder each round, so a lost
executor costs a re-read.  A star's centre may hold most edges: its minimum is
pre-aggregated before the shuffle and the join's skewed side is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.shared import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation; ``edges``: rows a > b."""
    near = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = least.select("a", F.col("m").alias("b"))
        out = moved.unionByName(kept)
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node it reaches."""
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = written(_star(_star(now, small=False), small=True))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
