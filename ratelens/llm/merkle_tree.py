"""Merkle manifest of a dataset: leaf digests, a tree per source, one root, and a proof for every row.

Subtrees of ``FANOUT ** DEPTH`` consecutive nodes are superblocks.  Going up, a
task reduces the superblocks it holds to one node each; the nodes left are the
next round's input.  Going down, the nodes of a superblock are cogrouped with
the one outer row it needs (the siblings on the way from its top to the root,
which the round above computed).  A task then finishes the local reduction,
joins each node's own siblings with the outer ones, and folds the path.

* Leaves are digests computed in the JVM, so texts are read once and never
  shuffled; what moves is some 100 bytes a row.
* Numbers in a source come from one range partitioning by (source, doc_id,
  leaf), a stored sorted table, and row counts by (partition, source): a source
  that holds a third of all rows spreads over its share of the partitions, and
  no window sees more rows than there are partitions of one source.
* Superblocks are dealt by hash in bundles of about ``BUNDLE_ROWS`` nodes, so
  many small sources don't mean many tiny tasks, and a bundle's memory doesn't
  grow with the table.  Rounds grow with the logarithm (base 4096) of the
  largest source; the driver sees counts only.
* Every round is a stored table in the shared folder: a lost executor costs a
  re-read.

Defined results: null fields count as ``-`` (a null doc_id or source as well;
null sources form one source, the first); a null doc_id is never tampered with;
equal doc_ids are ordered by leaf digest, and rows equal in all five fields
get neighbouring places in any order; an empty table gives an empty result;
texts of any length are hashed whole; a lone leaf is its source's subroot, a
lone subroot the root, without hashing; of the input only the five fields
are read, so other columns can't clash.  doc_id may be of any type that casts
to a string and back; order is that type's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.shared import partitions_for, ship, written

FANOUT, DEPTH = 16, 3
SUPERBLOCK = FANOUT**DEPTH
#: Nodes that a bundle of superblocks holds on average.
BUNDLE_ROWS = 16_384
#: Fields of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields: each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for f in fields:
        t = f.cast("string")
        parts.append(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, and the leaf after tampering: lower-cased text where ``tampered`` holds, else null."""
    fields = [F.col(c) for c in FIELDS]
    bad = F.lit(None).cast("binary")
    if tampered is not None:
        bad = F.when(tampered, leaf_digest([*fields[:-1], lower_ascii(fields[-1])]))
    return docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), bad.alias("bad"))


def numbered(rows: DataFrame, order: list[str], group: str) -> DataFrame:
    """``rows`` with ``tree`` (the group's place among groups, from 0), ``n`` (its rows) and ``idx`` (the row's place in it)."""
    spread = rows.repartitionByRange(partitions_for(rows.sparkSession), group, *order)
    spread = spread.sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    spread = written(spread).withColumn("_part", F.shiftright("_at", 33))
    runs = written(spread.groupBy("_part", group).agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n")))
    # at most one run of a group in each partition
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    firsts = runs.groupBy(group).agg(F.min("_start").alias("_first"), F.sum("_n").alias("n"))
    # groups ordered by their first row: by partition, and inside it by a window over its groups
    firsts = firsts.withColumn("_home", F.shiftright("_first", 33))
    homes = firsts.groupBy("_home").count()
    below = Window.orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    homes = homes.withColumn("_skip", F.coalesce(F.sum("count").over(below), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_home").orderBy("_first"))
    trees = written(
        firsts.join(homes.drop("count"), "_home").select(F.col(group).alias("_group"), "n", (F.col("_skip") + inside - 1).alias("tree"))
    )
    runs = runs.join(trees, F.col(group).eqNullSafe(F.col("_group"))).select(
        F.col("_part").alias("_p"), F.col(group).alias("_g"), "_start", "_before", "tree", "n"
    )
    at = spread.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    idx = F.col("_at") - F.col("_start") + F.col("_before")
    return at.select(*rows.columns, "tree", "n", idx.alias("idx"))


def digest(nodes: list[bytes]) -> bytes:
    """The node over a run: SHA-256 of its nodes' hex digests."""
    return hashlib.sha256("".join([d.hex() for d in nodes]).encode()).digest()


def climb(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels over a superblock's nodes: up to one node in a whole tree, else ``DEPTH`` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= DEPTH:
        now = levels[-1]
        levels.append([digest(now[k : k + FANOUT]) for k in range(0, len(now), FANOUT)])
    return levels


def own_path(levels: list[list[bytes]], k: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place in its run, the run's other nodes) of node ``k`` on each level below the top."""
    for now in levels[:-1]:
        start = k // FANOUT * FANOUT
        run = now[start : start + FANOUT]
        yield k - start, run[: k - start] + run[k - start + 1 :]
        k //= FANOUT


def packed(path: list[tuple[int, list[bytes]]]) -> tuple[bytes, bytes]:
    """A path as (place, sibling count) bytes and the siblings' digests."""
    return bytes(b for at, others in path for b in (at, len(others))), b"".join(d for _, others in path for d in others)


def unpacked(places: bytes, nodes: bytes) -> list[tuple[int, list[bytes]]]:
    path, k = [], 0
    for at, count in zip(places[::2], places[1::2], strict=True):
        path.append((at, [nodes[k + 32 * j : k + 32 * j + 32] for j in range(count)]))
        k += 32 * count
    return path


def fold(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, others in path:
        leaf = digest([*others[:at], leaf, *others[at:]])
    return leaf


def _units(rows: pd.DataFrame) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """A bundle's superblocks, their nodes in order."""
    rows = rows.sort_values(["tree", "idx"], kind="stable")
    unit = (rows["idx"] // SUPERBLOCK).to_numpy()
    tree = rows["tree"].to_numpy()
    cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(unit) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        if b > a:
            yield (int(tree[a]), int(unit[a])), rows.iloc[a:b]


def _bundled(nodes: DataFrame, unit: Column, bundles: int) -> DataFrame:
    return nodes.withColumn("bundle", F.pmod(F.xxhash64("tree", unit), F.lit(bundles)))


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (tree, unit), part in _units(rows):
        n = int(part["n"].iloc[0])
        top = climb(part["digest"].tolist(), n <= SUPERBLOCK)[-1][0]
        out.append((tree, -(-n // SUPERBLOCK), unit, top))
    return pd.DataFrame(out, columns=["tree", "n", "idx", "digest"])


def _extend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Each node's whole path: its own part in the superblock, then the superblock's."""
    rows = outer[["tree", "unit", "places", "nodes", "subroot", "root"]].itertuples(index=False)
    over = {(tree, unit): rest for tree, unit, *rest in rows}
    out = []
    for (tree, unit), part in _units(nodes):
        places, siblings, sub, root = over[tree, unit]
        levels = climb(part["digest"].tolist(), int(part["n"].iloc[0]) <= SUPERBLOCK)
        for k, idx in enumerate(part["idx"].tolist()):
            p, s = packed(list(own_path(levels, k)))
            out.append((tree, idx, p + places, s + siblings, sub, root))
    return pd.DataFrame(out, columns=["tree", "idx", "places", "nodes", "subroot", "root"])


def _prove(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Each leaf's proof, and the root folded from the leaf as found."""
    paths = _extend(nodes[["tree", "idx", "n", "digest"]], outer)
    rows = nodes.sort_values(["tree", "idx"], kind="stable")
    folded = [
        fold(bad if bad is not None else good, unpacked(p, s))
        for good, bad, p, s in zip(rows["digest"], rows["bad"], paths["places"], paths["nodes"], strict=True)
    ]
    return pd.DataFrame(
        {
            "key": rows["key"].tolist(),
            "leaf": rows["digest"].tolist(),
            "subroot": paths["subroot"],
            "root": paths["root"],
            "places": paths["places"],
            "siblings": paths["nodes"],
            "folded": folded,
        }
    )


NODE = "tree long, n long, idx long, digest binary"
PATH = "tree long, idx long, places binary, nodes binary, subroot binary, root binary"
PROOF = "key string, leaf binary, subroot binary, root binary, places binary, siblings binary, folded binary"


class Forest:
    """The rounds over trees of nodes (tree, n, idx, digest): ``rounds[0]`` are the nodes given, ``tops`` each tree's root."""

    def __init__(self, nodes: DataFrame):
        self.rounds, self.bundles, tops = [nodes], [], []
        while True:
            now = self.rounds[-1]
            total, most = now.agg(F.count(F.lit(1)), F.max("n")).first()
            self.bundles.append(max(1, -(-total // BUNDLE_ROWS)))
            if not total or most == 1:
                tops.append(now.select("tree", "digest"))
                break
            unit = F.floor(F.col("idx") / SUPERBLOCK)
            tops.append(now.where("n = 1").select("tree", "digest"))
            many = _bundled(now.where("n > 1").select("tree", "n", "idx", "digest"), unit, self.bundles[-1])
            self.rounds.append(written(many.groupBy("bundle").applyInPandas(_reduce, NODE)))
        self.tops = tops[0]
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)

    def outer(self, roots: DataFrame) -> DataFrame:
        """The outer row of each superblock of ``rounds[0]``; ``roots``: (tree, places, nodes, subroot, root) above each tree."""
        over = None
        for k in range(len(self.rounds) - 1, 0, -1):
            now = self.rounds[k]
            # at this round, trees of one node take the path over their root
            done = now.where("n = 1").select("tree", "idx").join(roots, "tree")
            paths = done.select("tree", "idx", "places", "nodes", "subroot", "root")
            if over is not None:
                paths = paths.unionByName(self.cogrouped(now.where("n > 1"), over, k).applyInPandas(_extend, PATH))
            over = written(paths.withColumnRenamed("idx", "unit"))
        lone = self.rounds[0].where("n = 1").select("tree", F.col("idx").alias("unit")).join(roots, "tree")
        lone = lone.select("tree", "unit", "places", "nodes", "subroot", "root")
        return written(lone if over is None else over.unionByName(lone))

    def cogrouped(self, nodes: DataFrame, outer: DataFrame, k: int = 0):
        left = _bundled(nodes, F.floor(F.col("idx") / SUPERBLOCK), self.bundles[k])
        right = _bundled(outer, F.col("unit"), self.bundles[k])
        return left.groupBy("bundle").cogroup(right.groupBy("bundle"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, the proof and the root folded from the leaf as found.

    Digests are binary.  The proof is ``places`` (for each level a byte for the
    node's place in its run and one for the number of siblings) and
    ``siblings`` (their digests, level by level, left to right).  ``folded``
    is computed from the leaf of the row as ``tampered`` leaves it.
    """
    ship(docs.sparkSession)
    rows = numbered(written(leaves(docs, tampered)), ["doc_id", "leaf"], "source")
    rows = written(rows.withColumnRenamed("leaf", "digest"))
    sources = Forest(rows)
    tops = written(sources.tops)
    count = tops.count()
    one = [F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("idx")]
    upper = Forest(tops.select(*one, "digest"))
    none = F.lit(b"").cast("binary")
    empty = [none.alias("places"), none.alias("nodes"), none.alias("subroot")]
    root = upper.tops.select("tree", *empty, F.col("digest").alias("root"))
    over = upper.cogrouped(upper.rounds[0], upper.outer(root)).applyInPandas(_extend, PATH)
    over = over.select(F.col("idx").alias("tree"), "places", "nodes", "root")
    roots = over.join(tops.withColumnRenamed("digest", "subroot"), "tree")
    outer = sources.outer(written(roots))
    keyed = rows.select("tree", "n", "idx", "digest", "bad", F.col("doc_id").cast("string").alias("key"))
    proofs = sources.cogrouped(keyed, outer).applyInPandas(_prove, PROOF)
    return proofs.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *[c for c in proofs.columns if c != "key"])
