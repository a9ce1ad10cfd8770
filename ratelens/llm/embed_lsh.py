"""Embedding near-dedup by random-hyperplane sign hashing.

Several tables of sign codes propose pairs; every pair in a bucket is checked
by exact cosine in double precision; links are joined into components.

* Equal vectors are one node with a count from the start, so a vector that a
  third of the rows share is hashed and compared once.
* Code length follows the number of nodes (``log2``, for buckets of bounded
  mean size); the number of tables follows from the chance that a pair at the
  threshold shares a code, so that it is missed with at most ``MISS``.
* A bucket larger than ``BLOCK`` is split by a hash into blocks, and each pair
  of blocks is a task of its own: no bucket is capped and none is one task.
* A pair that meets in several tables counts in the first only: each node
  carries all its codes.  Pairs never leave the task that compares them; it
  gives partial link counts and a spanning forest of its links.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing; vectors of different lengths don't link; rows
with a null vec_id take no part in links and have a null component; repeated
rows count as one vector each; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.graph import components
from ratelens.llm.shared import ship, written

COSINE = 0.95
#: Chance that a pair just at the threshold meets in no table.
MISS = 0.001
BLOCK = 2048
#: Code bits beyond log2 of the nodes: most codes of unrelated vectors are then their own.
SPARE_BITS = 3
SEED = 20


def layout(nodes: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a code, tables)."""
    bits = ceil(log(max(2, nodes), 2)) + SPARE_BITS
    share = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - share))


def component_type(vectors: DataFrame) -> str:
    """numpy's name of the vectors' component type; whatever isn't float counts as double."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def nodes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, the node (63-bit name) of its vector, null where it can't link, and the vector's bytes."""
    kind_of = component_type(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, names, raw = batch.column(0), [], []
            for v in batch.column(1).to_pylist():
                a = None if v is None or None in v else np.array(v, np.float64) + 0.0  # -0.0 equals 0.0
                good = a is not None and len(a) and np.isfinite(a).all() and a.any()
                data = a.astype(kind_of).tobytes() if good else None
                names.append(xxhash.xxh3_64_intdigest(data) >> 1 if good else None)
                raw.append(data)
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "node", "vector"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, node long, vector binary")


def coded(nodes: DataFrame, bits: int, tables: int, kind_of: str) -> DataFrame:
    """node, copies, vector, codes (one code a table, as bytes)."""
    code_type = "<i4" if bits < 32 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            codes = []
            for raw in batch.column("vector").to_pylist():
                v = np.frombuffer(raw, kind_of).astype(np.float64)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(SEED).standard_normal((tables * bits, len(v)))
                signs = (planes[len(v)] @ (v / np.abs(v).max()) >= 0).reshape(tables, bits)
                codes.append((signs @ weights).astype(code_type).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], ["node", "copies", "vector", "codes"])

    return nodes.select("node", "copies", "vector").mapInArrow(run, "node long, copies long, vector binary, codes binary")


def in_buckets(codes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, dim, t, code: one row per node and table."""
    code_type = "<i4" if bits < 32 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), code_type).astype(np.int64)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), tables)
            dim = np.repeat(batch.column("dim").to_numpy(zero_copy_only=False), tables)
            t = np.tile(np.arange(tables, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(dim), pa.array(t), pa.array(c)], ["node", "dim", "t", "code"])

    sized = codes.select("node", F.length("vector").cast("int").alias("dim"), "codes")
    return sized.mapInArrow(run, "node long, dim int, t int, code long")


def compare(block: pa.Table, cosine: float, kind_of: str, code_type: str) -> pa.Table:
    """Links among the rows of a block pair: (a, b) with b null for a's number of links here, else a tree edge."""
    t = block.column("t")[0].as_py()
    node = block.column("node").to_numpy()
    side = block.column("side").to_numpy()
    copies = block.column("copies").to_numpy()
    x = np.stack([np.frombuffer(v, kind_of) for v in block.column("vector").to_pylist()]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    codes = np.stack([np.frombuffer(c, code_type) for c in block.column("codes").to_pylist()])
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    within = block.column("x")[0].as_py() == block.column("y")[0].as_py()
    if within:
        right = left
    parent = np.arange(len(node))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = np.zeros(len(node), np.int64)
    edges: list[tuple[int, int]] = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        if within:
            i, j = i[i < j], j[i < j]
        if t and len(i):
            first = ~(codes[i, :t] == codes[j, :t]).any(axis=1)
            i, j = i[first], j[first]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                edges.append((a, b))
    own = np.flatnonzero(links)
    a = np.concatenate([node[own], node[np.array([e[0] for e in edges], np.int64)]])
    b = [None] * len(own) + [int(node[e[1]]) for e in edges]
    n = [int(k) for k in links[own]] + [0] * len(edges)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def neighbours(nodes: DataFrame, bits: int, tables: int, cosine: float, kind_of: str) -> DataFrame:
    """(a, null, rows linked with a found in a block) and (a, b, 0) for tree edges."""
    codes = written(coded(nodes, bits, tables, kind_of))
    rows = in_buckets(codes, bits, tables)
    key = ["dim", "t", "code"]
    sizes = rows.groupBy(*key).count().where("count > 1")
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    member = rows.join(sizes, key).withColumn("of", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    # a block meets every block, itself included; the lower of two is the left side
    spread = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select(
        "node",
        *key,
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    code_type = "<i4" if bits < 32 else "<i8"
    return (
        spread.join(codes, "node")
        .groupBy(*key, "x", "y")
        .applyInArrow(lambda b: compare(b, cosine, kind_of, code_type), "a long, b long, n long")
    )


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    ship(vectors.sparkSession)
    rows = written(nodes_of(vectors))
    usable = rows.where("node is not null and vec_id is not null")
    nodes = written(
        usable.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector"))
    )
    bits, tables = layout(nodes.count(), cosine)
    found = written(neighbours(nodes, bits, tables, cosine, component_type(vectors)))
    edges = written(found.where("b is not null").select("a", "b"))
    comp = written(components(edges))
    label = nodes.select("node", "copies", "least_id").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = label.groupBy("component").agg(F.min("least_id").alias("component_id"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    by_node = label.join(least, "component").join(links, "node", "left").select(
        F.col("node").alias("_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id"
    )
    out = rows.drop("vector").join(by_node, (F.col("node") == F.col("_node")) & F.col("vec_id").isNotNull(), "left")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
