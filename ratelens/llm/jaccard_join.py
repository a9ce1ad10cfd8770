"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Two documents link when the Jaccard similarity of their shingle sets is at
least ``least / 100``.

1. **Segments by size band.**  Sets are banded by size so that linked sets lie
   in the same or in neighbouring bands; a set is indexed in its own band and,
   where a smaller partner may exist, in the one below.  In a band at most
   ``k`` shingles differ between linked sets, ``k`` following from the band's
   largest sizes.  The universe (64-bit shingle hashes) is cut into ranges.
2. **Signatures.**  Each range gets a budget: 1 indexes the set's subset in the
   range, 2 indexes the subset and its one-deletion neighbourhood.  Budgets sum
   to ``k + 1``, so linked sets differ in some range by less than its budget
   and share a signature there.  Budgets are chosen per band by cost: many
   small subsets (few signatures, each shared by more unrelated sets) against
   half as many ranges with neighbourhoods.
3. An **empty range** would meet every other set with that range empty.  It
   gets budget 0 and the next range gets 2, in a name space of its own; sums
   stay ``k + 1`` for two sets that both have it empty.
4. **Exact verification** of candidate pairs on their whole shingle sets.

Equal sets are one node from the start.  In each group of sets that share a
signature, all are compared with the most central one first (whose signatures
are shared most): one comparison a member, however large a group of near copies
is.  What is then in different components is compared pairwise.  Both are done
on parity sketches first: a sketch bit is the parity of the shingles that hash
to it, so sketches of two sets differ in no more bits than the sets in shingles,
and a pair whose sketches differ too much can't link.  Pairs stay in the task
that compares them, large groups as blocks that meet in tasks of their own; only
those that pass are verified exactly.  If a pair of a star fails there, what it
kept apart from comparison is compared after all.  So no link is lost.

Shingles are compared by 64-bit hashes.  Defined results: a document with fewer
words than the shingle size has one shingle, the whole sequence; one without
words or with a null text has an empty set, links with nothing and is its own
component; rows with a null doc_id get a null component and link nothing;
repeated rows come back each; other columns are not carried; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.graph import components
from ratelens.llm.shared import free_name, mix64, ragged, release, ship, text_digest, with_text, written

SHINGLE = 5
LEAST = 80
#: Cost of comparing a pair, in signatures, and the chance that an element of a
#: subset agrees between two sets that don't link.
PAIR_COST = 4.0
AGREE = 0.02
BYTES_PER_WORD = 6.0
#: Members of a block when groups are compared pairwise.
BLOCK = 1024
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 18


def places(at: np.ndarray) -> np.ndarray:
    """The odd factor of each place in a word or shingle."""
    return mix64(at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte: A-Z as a-z, 0 for the white space that ends words."""
    values = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[[0x20, *range(0x09, 0x0E)]] = 0
    return values


BYTE = byte_values()
PLACE = places(np.arange(4096))


def factors(at: np.ndarray) -> np.ndarray:
    return PLACE[at] if at.max() < len(PLACE) else places(at)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased: the sum of its bytes' values times their places'."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], BYTE[raw] != 0])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    sums = np.zeros(len(starts), np.uint64)
    # in pieces, also inside a word, so that a text of any length takes little more than its own bytes
    for at in range(starts[0] if len(starts) else len(raw), len(raw), PIECE):
        end = min(at + PIECE, len(raw))
        first, last = np.searchsorted(starts, [at, end - 1], side="right") - 1
        own = starts[first : last + 1]
        bounds = np.concatenate([np.maximum(own, at) - at, [end - at]])
        place = np.arange(at, end) - np.repeat(own, bounds[1:] - bounds[:-1])
        sums[first : last + 1] += np.add.reduceat(BYTE[raw[at:end]] * factors(place), bounds[:-1])
    return sums


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k, times in enumerate(factors(np.arange(size))):
        h += words[k : k + n] * times
    h = mix64(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def node_of(shingles: np.ndarray) -> int:
    """A set's 63-bit name."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by hash; at least as many bits as shingles, a power of two."""
    bits = 64
    while bits < len(shingles):
        bits *= 2
    parity = np.bincount((mix64(shingles) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches at the shortest one's length: halves add up as parities."""
    size = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, size), axis=0) for x in sketches])


class Bands:
    """Size bands, the bound on differences in each, and the ranges with their budgets."""

    def __init__(self, least: int, sets: dict[int, int] | None = None) -> None:
        self.least = least
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            # a band's largest set still links with its smallest
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 100 // least + 1))
        self.sets = sets or {}
        self._plan: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def differences(self, band: int) -> int:
        """Most differing shingles between linked sets, the smaller of them in ``band``."""
        small = self.lows[band + 1] - 1
        large = small * 100 // self.least
        # |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|)
        return (100 - self.least) * (small + large) // (100 + self.least)

    def plan(self, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inner bounds of the ranges in hash space, their budgets and their names."""
        if band not in self._plan:
            k = self.differences(band)
            size, others = self.lows[band], self.sets.get(band, 1)
            ones, pairs = k + 1, (k + 1) // 2
            cost_ones = ones * (1 + PAIR_COST * others * AGREE ** (size / ones))
            cost_pairs = size + pairs + PAIR_COST * others * pairs * AGREE ** (size / max(1, pairs) - 1)
            budgets = [1] * ones if cost_ones <= cost_pairs else [2] * pairs + [1] * (ones % 2)
            ends = np.cumsum(budgets)[:-1].astype(object) * (1 << 64) // sum(budgets)
            names = mix64(np.arange(len(budgets), dtype=np.uint64) + np.uint64(band << 32))
            self._plan[band] = np.array([int(e) for e in ends], np.uint64), np.array(budgets), names
        return self._plan[band]

    def homes(self, n: int) -> list[int]:
        """Bands in which a set of ``n`` shingles is indexed."""
        band = self.of(n)
        out = [band]
        # a smaller partner has at least n * least / 100 shingles
        if band and (n * self.least + 99) // 100 < self.lows[band]:
            out.append(band - 1)
        return out


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The set's signatures."""
    found = [np.zeros(0, np.uint64)]
    # a subset is named by its sum: shingles are hashes already, and what is found is verified exactly
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles, dtype=np.uint64)])
    for band in bands.homes(len(shingles)) if len(shingles) else ():
        bounds, budgets, names = bands.plan(band)
        m = len(budgets)
        cut = np.concatenate([[0], np.searchsorted(shingles, bounds), [len(shingles)]])
        subset = sums[cut[1:]] - sums[cut[:-1]]
        lens = cut[1:] - cut[:-1]
        near, spaces = np.flatnonzero(budgets == 2), names[budgets == 2]
        # with neighbourhoods in the plan ranges are wide and an empty one is a subset like others
        if len(near) or m == 1 or lens.all():
            found.append(subset ^ names)
        else:
            found.append((subset ^ names)[lens > 0])
            # the next range of an empty one, in a name space of its own
            empty = np.flatnonzero(lens == 0)
            near = (empty + 1) % m
            spaces = mix64(names[empty] + names[near])
            found.append(subset[near] ^ spaces)
        if len(near):
            # the subset without each one of its elements
            without = np.repeat(subset[near], lens[near]) - ragged(shingles, cut[:-1], lens, near)
            found.append(without ^ np.repeat(spaces, lens[near]))
    return np.concatenate(found)


def bands_for(docs: DataFrame, least: int) -> Bands:
    """Bands with an estimate of the sets in each (from text lengths), for the cost of a plan."""
    words = F.greatest(F.lit(1.0), F.length(F.col("text").cast("binary")) / F.lit(BYTES_PER_WORD))
    step = log(100 / least) / 2
    rows = docs.groupBy(F.floor(F.log(words) / F.lit(step)).alias("k")).count().where("k is not null").collect()
    bands = Bands(least)
    for r in rows:
        band = bands.of(max(1, int(np.exp((r["k"] + 0.5) * step))))
        bands.sets[band] = bands.sets.get(band, 0) + r["count"]
    return bands


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node, sketch and the text's digest; a task gives a set's sketch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                count, nodes, sketches = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_set(text, size)
                    node = node_of(s) if len(s) else None
                    new = node is not None and doc is not None and node not in seen
                    sketches.append(sketch_of(s) if new else None)
                    if new:
                        seen.add(node)
                    count.append(len(s))
                    nodes.append(node)
                cols = [part.column(0), pa.array(count, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *part.columns[2:]], ["doc_id", "n_shingles", "node", "sketch", "t1", "t2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", *(d.alias(t) for d, t in zip(text_digest(), ("t1", "t2"), strict=True)))
    return with_text(named, "t1", "t2").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, sketch binary, t1 long, t2 long")


def signed(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """sig, node: the signatures of all sets; a task gives a set's signatures once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                nodes, sigs = [], [np.zeros(0, np.uint64)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_set(text, size) if doc is not None else ()
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sigs.append(signatures(s, bands))
                each = [len(x) for x in sigs[1:]]
                cols = [np.concatenate(sigs).view(np.int64), np.repeat(np.array(nodes, np.int64), each)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["sig", "node"])

    return with_text(docs).mapInArrow(run, "sig long, node long")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id): only these texts are read into sets again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                same = [len(s) and node_of(s) == n for s, n in zip(sets, part.column(0).to_pylist(), strict=True)]
                nodes = [n for n, k in zip(part.column(0).to_pylist(), same, strict=True) if k]
                raw = [s.tobytes() for s, k in zip(sets, same, strict=True) if k]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], ["node", "shingles"])

    # the wanted sets grow with the documents: a merge join at every size
    texts = with_text(docs).join(wanted.withColumnRenamed("doc_id", "_id").hint("merge"), F.col("doc_id") == F.col("_id"))
    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= least * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def labelled(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) by the links, and the members of groups that are in more than one component."""
    comp = written(components(links))
    members = groups.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    unresolved = members.groupBy("sig").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("sig")
    return comp, written(members.join(unresolved, "sig"))


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each group's most central member and those in other components."""
    lead = members.groupBy("sig").agg(F.max(F.struct("central", "node", "component")).alias("lead"))
    pairs = members.join(lead, "sig").where("component <> lead.component")
    return pairs.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct()


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, least: int) -> np.ndarray:
    """Whether sizes, and bits that differ between sketches, allow a link."""
    return (100 * np.minimum(n, m) >= least * np.maximum(n, m)) & (differ <= (100 - least) * (n + m) // (100 + least))


def sketched(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            both = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            differ = np.fromiter((np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum() for x, y in both), np.int64, batch.num_rows)
            ok = pa.array(may_link(n, m, differ, least), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(ok)

    a = sketches.select(F.col("node").alias("a"), "n", F.col("sketch").alias("sa"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "sa", "sb").mapInArrow(run, "a long, b long")


def close_pairs(block: pa.Table, least: int) -> pa.Table:
    """Pairs of a block pair in different components whose sizes and sketches allow a link."""
    node, n, comp, side = (block.column(c).to_numpy() for c in ("node", "n", "component", "side"))
    within = block.column("x")[0].as_py() == block.column("y")[0].as_py()
    sketch = folded(block.column("sketch").to_pylist())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1))
    out = [np.zeros((0, 2), np.int64)]
    for k, i in enumerate(left):
        j = right[k + 1 :] if within else right
        j = j[comp[j] != comp[i]]
        j = j[may_link(n[i], n[j], np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64), least)]
        out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
    a, b = np.concatenate(out).T
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def remaining_pairs(members: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) that the sketches leave, from all pairs of a group in different components."""
    # the star has compared both members of a group of two
    sizes = members.groupBy("sig").count().where("count > 2").withColumn("of", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int"))
    placed = members.join(sizes, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    # a block meets every block, itself included; the lower of two is the left side
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select(
        "sig",
        "node",
        "component",
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    pairs = spread.join(sketches, "node").groupBy("sig", "x", "y").applyInArrow(lambda b: close_pairs(b, least), "a long, b long")
    return pairs.distinct()


def shared_groups(sig: DataFrame) -> DataFrame:
    """sig, node, central: the members of groups of two or more, each set of members once.

    Sets that share a passage share all its signatures; one of such equal groups is enough.
    """
    every = Window.partitionBy("sig")
    ends = (F.min("node").over(every).alias("least"), F.max("node").over(every).alias("most"))
    # tasks may have given a set's signatures twice
    shared = written(sig.select("*", *ends).where("least <> most").select("sig", "node").distinct())
    sizes = shared.groupBy("sig").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    one = sizes.groupBy("size", "x", "y").agg(F.min("sig").alias("sig"))
    central = shared.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("central"))
    return written(shared.join(one.select("sig"), "sig").join(central, "node"))


def linked_nodes(docs: DataFrame, feats: DataFrame, size: int, least: int) -> DataFrame:
    """(node, component) for the sets that link with another."""
    groups = shared_groups(signed(docs, size, bands_for(docs, least)))
    if groups.isEmpty():
        return docs.sparkSession.createDataFrame([], "node long, component long")
    nodes = feats.where("sketch is not null and doc_id is not null").groupBy("node")
    nodes = nodes.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.join(groups.select("node").distinct(), "node", "left_semi"))
    sketches = nodes.select("node", "n", "sketch")

    def links_of(pairs: DataFrame) -> DataFrame:
        """The pairs that link; whole texts are read again for sets in pairs that may."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = written(sets_of(docs, nodes.select("node", "doc_id").join(wanted, "node", "left_semi"), size))
        return written(verified(pairs, sets, least))

    star = written(sketched(star_pairs(groups.withColumn("component", F.col("node"))), sketches, least))
    # as if these all linked, to spare the pairs within their components
    _, rest = labelled(groups, star)
    pairs = star.unionByName(written(remaining_pairs(rest, sketches, least)))
    links = links_of(pairs)
    comp, rest = labelled(groups, links)
    if rest.isEmpty():
        return comp
    # pairs that were spared for a star that doesn't hold
    again = written(remaining_pairs(rest, sketches, least).join(pairs, ["a", "b"], "left_anti"))
    return comp if again.isEmpty() else components(links.unionByName(links_of(again)))


def labelled_rows(docs: DataFrame, size: int, least: int) -> DataFrame:
    """The features of every row and its component's smallest doc_id (null for an empty set), least_id."""
    ship(docs.sparkSession)
    feats = written(features(docs, size))
    comp = linked_nodes(docs, feats, size, least)
    nodes = feats.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    label = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_component = label.groupBy("component").agg(F.min("least_id").alias("least_id"))
    found = label.drop("least_id").join(by_component, "component").select(F.col("node").alias("_node"), "component", "least_id")
    return feats.join(found, F.col("node") == F.col("_node"), "left").drop("_node", "sketch")


def join_classes(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, itself included."""
    return labelled_rows(docs, size, least).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("least_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """One document of each group: of its rows, the one with the smallest (doc_id, text digest); ids that are null come last.

    A document is a doc_id and a text: rows that share an id but hold texts of
    different groups all stay, rows equal in both are one.  Rows without an id
    join the group of rows with the same shingles only, since their texts can't
    be found again by id for the exact comparison.  Texts without words are
    groups of their own.
    """
    rows = labelled_rows(docs, size, least)
    name = F.struct(F.col("doc_id").isNull().alias("anon"), "doc_id", "t1", "t2")
    each = rows.groupBy("component", name.alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    first = each.where("component is not null").groupBy("component").agg(F.min(F.struct("doc", "n")).alias("f"))
    first = first.select("f.doc", "f.n").unionByName(each.where("component is null").select("doc", "n"))
    doc, one, two, n = (free_name(docs.columns, c) for c in ("_doc", "_t1", "_t2", "_n"))
    first = written(first.select(F.col("doc.doc_id").alias(doc), F.col("doc.t1").alias(one), F.col("doc.t2").alias(two), F.col("n").alias(n)))
    t1, t2 = text_digest()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (t1 == F.col(one)) & (t2 == F.col(two))
    kept = docs.join(first, same, "left_semi")
    # rows equal in id and text, where there are any
    return kept if first.where(F.col(n) > 1).isEmpty() else kept.dropDuplicates(["doc_id", "text"])
