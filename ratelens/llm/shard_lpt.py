"""Longest-processing-time sharding.

Groups of equal texts stay together.  Groups are sorted by size and go to the
least-loaded shard through a heap.

* Groups are found by the SHA-256 of the text and sized in one aggregation, so
  a text that a third of the rows share is one row before any shuffle by key.
* Groups over ``total / (shards * bundles_per_shard)`` bytes are items of their
  own: fewer than ``shards * bundles_per_shard`` exist, whatever the input.
  Smaller groups are joined into at most that many bundles by a hash of their
  digest.  So the heap on the driver sees at most twice that many items, and
  the spread of the loads stays within the largest item.
* Slots are numbered in two steps: a count for each (shard, chunk), then
  positions inside a chunk, so no task sorts a whole shard.

Defined results: a null text is a text of no bytes and its own group (null);
repeated rows are separate rows of one group; ties in size go by item key, ties
in load by shard number; an empty table gives an empty result; the columns of
the input, but for doc_id and text, are not carried.  Equal doc_ids are
ordered arbitrarily among their slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.shared import written

#: Bytes that each row costs beside its text.
ROW_BYTES = 16
#: Rows that a chunk holds on average when slots are numbered.
CHUNK_ROWS = 100_000


def lpt(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """item key -> shard; ``items``: (size, key)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        placed[key] = s
        heapq.heappush(heap, (load + size, s))
    return placed


def sized(docs: DataFrame, group: Column) -> DataFrame:
    """doc_id, size, group digest and the text's CRC-32."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(
        F.col("doc_id"),
        (F.length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        group.alias("_group"),
    )


def assign(rows: DataFrame, shards: int, bundles_per_shard: int = 1000) -> DataFrame:
    """``rows`` (with size and _group) with the shard of each row's group."""
    spark = rows.sparkSession
    groups = written(rows.groupBy("_group").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0]
    if total is None:
        return rows.withColumn("shard", F.lit(0))
    bins = shards * bundles_per_shard
    large = F.col("bytes") * F.lit(bins) > F.lit(total)
    # negative keys: bundles; others: a hash that names a large group
    key = F.when(large, F.pmod(F.xxhash64("_group"), F.lit(1 << 62))).otherwise(
        -1 - F.pmod(F.xxhash64("_group", F.lit(7)), F.lit(bins))
    )
    keyed = groups.select("_group", "bytes", key.alias("_item"))
    items = keyed.groupBy("_item").agg(F.sum("bytes").alias("bytes")).collect()
    placed = lpt([(r["bytes"], r["_item"]) for r in items], shards)
    plan = spark.createDataFrame(list(placed.items()), "_item long, shard int")
    by_group = keyed.join(plan, "_item").select("_group", "shard")
    # a null-safe key: the group of null texts matches itself
    return rows.join(by_group.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")


def numbered(rows: DataFrame, part: str, order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each ``part``."""
    total = rows.count()
    chunks = max(1, -(-total // chunk_rows))
    chunked = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = chunked.groupBy(part, "_chunk").count()
    before = Window.partitionBy(part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(part, "_chunk").orderBy(*order)
    return (
        chunked.join(offsets, [part, "_chunk"])
        .withColumn("slot", (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_chunk", "_before")
    )


def shard_documents(docs: DataFrame, shards: int = 40, bundles_per_shard: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of ``docs``."""
    rows = sized(docs, F.sha2(F.col("text").cast("binary"), 256))
    rows = written(rows)
    placed = written(assign(rows, shards, bundles_per_shard).drop("_group"))
    return numbered(placed, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
