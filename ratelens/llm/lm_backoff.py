"""Language-model scores by stupid backoff, computed relationally.

n-gram counts are taken over the whole corpus and joined to the documents'
n-grams by hash.  A document is scored against all others (its own n-grams are
taken off the counts), so a text that only repeats itself gains nothing:

    S(w | v)   = count(v w) / count(v)       if count(v w) > 0
               = BACKOFF * S(w)              else
    S(w)       = count(w) / N                if count(w) > 0
               = 1 / (N + 1)                 else

with the counts of the other documents, up to ``order`` words.  The score is
the sum of log10 S over a document's words; a word's history is what precedes
it in the document.

1. A block of documents lists its distinct n-grams (64-bit hashes) with their
   counts, cut by hash into buckets: one row per block and bucket.
2. Each bucket's task adds the counts of all blocks: its part of the n-gram
   count table.  It answers each block with the totals of the n-grams it asked
   for.  A very common n-gram is one entry per block, whatever its count.
3. The answers meet the block's documents, whose n-grams are numbered alike,
   and each document's scores are summed.

Counts are exact but for collisions of 64-bit hashes.  Defined results: a null
or empty text has no words and score 0; repeated rows are separate documents; a
corpus of one document leaves all its words unseen; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.blocks import blocks
from ratelens.llm.shared import Numbering, mix64, pack_ints, partitions_for, ship, unpack_ints, with_text, words_of

ORDER = 2
BACKOFF = 0.4
#: Text bytes of a block: larger blocks ask for an n-gram less often and take more memory.
BLOCK_BYTES = 14 << 20


class Grams:
    """A block's words and its distinct n-grams of each order."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        import xxhash

        words = Numbering()
        used = [words.of(words_of(t)) for t in texts]
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, words.order), np.uint64, len(words.order))
        self.set(used, names, order)

    def set(self, used: list[np.ndarray], names: np.ndarray, order: int) -> None:
        """``used``: the word numbers of each document; ``names``: the words' hashes."""
        self.n_words = np.fromiter(map(len, used), np.int64, len(used))
        self.names = names
        flat = np.concatenate([np.zeros(0, np.int64), *used])
        doc = np.repeat(np.arange(len(used)), self.n_words)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        self.flat, self.doc = flat, doc
        # per order: position of each window's last word, its gram's number, the grams' hashes
        self.last, self.gram, self.hash = [], [], []
        gram, last, hashes = flat, np.arange(len(flat)), mix64(names)
        for n in range(1, order + 1):
            if n > 1:
                # a longer window is the shorter one that ends a word earlier, and its last word
                inside = place[last] + 1 < self.n_words[doc[last]]
                code = gram[inside] * max(1, len(names)) + flat[last[inside] + 1]
                last = last[inside] + 1
                distinct, gram = np.unique(code, return_inverse=True)
                hashes = mix64(hashes[distinct // max(1, len(names))] * np.uint64(0x9E3779B97F4A7C15) + names[distinct % max(1, len(names))])
            self.last.append(last)
            self.gram.append(gram)
            self.hash.append(hashes)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def asked(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, block, order, hashes, counts: each block's distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(batches, BLOCK_BYTES):
            grams = Grams(texts, order)
            for n in range(order):
                h = grams.hash[n]
                counts = np.bincount(grams.gram[n], minlength=len(h))
                b = bucket_of(h, buckets)
                by = np.argsort(b, kind="stable")
                ends = np.cumsum(np.bincount(b, minlength=buckets))
                for k in np.flatnonzero(np.diff(ends, prepend=0)):
                    at = by[ends[k - 1] if k else 0 : ends[k]]
                    row = [pa.array([int(k)]), pa.array([block]), pa.array([n], pa.int32())]
                    row += [pa.array([h[at].tobytes()], pa.binary()), pa.array([pack_ints(counts[at])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, ["bucket", "block", "n", "hashes", "counts"])

    return with_text(docs).mapInArrow(run, "bucket long, block long, n int, hashes binary, counts binary")


def answered(asks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, order, totals: the corpus counts of what each block asked."""

    def totals(bucket: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in bucket.column("hashes").to_pylist()]
        counts = np.concatenate([unpack_ints(x) for x in bucket.column("counts").to_pylist()]).astype(np.int64)
        _, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, weights=counts).astype(np.int64)[back]
        ends = np.cumsum([len(h) for h in hashes])
        out = [total[e - len(h) : e] for e, h in zip(ends, hashes, strict=True)]
        # counts over 32 bits take two parts
        packed = [pack_ints(np.concatenate([x & 0xFFFFFFFF, x >> 32])) for x in out]
        kept = [bucket.column(c) for c in ("bucket", "block", "n")]
        return pa.table([*kept, pa.array(packed, pa.binary())], names=["bucket", "block", "n", "totals"])

    return asks.groupBy("n", "bucket").applyInArrow(totals, "bucket long, block long, n int, totals binary")


def used_words(docs: DataFrame) -> DataFrame:
    """block, doc_ids, counts, order, names: the words of the block's documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, BLOCK_BYTES):
            grams = Grams(texts, 1)
            row = [
                pa.array([block]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([pack_ints(grams.n_words)], pa.binary()),
                pa.array([pack_ints(grams.flat)], pa.binary()),
                pa.array([grams.names.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "counts", "order", "names"])

    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return with_text(ids).mapInArrow(run, "block long, doc_ids array<long>, counts binary, order binary, names binary")


def own_counts(grams: Grams, n: int) -> np.ndarray:
    """For each window, how often its n-gram stands in its own document."""
    key = grams.doc[grams.last[n]] * max(1, len(grams.hash[n])) + grams.gram[n]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[back]


def log_scores(grams: Grams, totals: list[np.ndarray], corpus: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Per document: sum of log10 S, and the words scored by the longest order they could have."""
    size = len(grams.flat)
    others = (corpus - grams.n_words)[grams.doc].astype(float)
    count = totals[0][grams.gram[0]] - own_counts(grams, 0)
    score = np.where(count > 0, count / np.maximum(others, 1), 1 / (others + 1))
    full = np.zeros(size, bool)
    shorter = np.zeros(size)  # count of the (n - 1)-gram that ends at each position
    shorter[:] = count
    for n in range(1, len(totals)):
        at = grams.last[n]
        count = totals[n][grams.gram[n]] - own_counts(grams, n)
        history = shorter[at - 1]
        score[at] = np.where(count > 0, count / np.maximum(history, 1), backoff * score[at])
        full = np.zeros(size, bool)
        full[at[count > 0]] = True
        shorter = np.zeros(size)
        shorter[at] = count
    docs = len(grams.n_words)
    return np.bincount(grams.doc, weights=np.log10(score), minlength=docs), np.bincount(grams.doc, weights=full, minlength=docs)


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, n_matched (words whose full n-gram other documents have), log_score, mean_log_score."""
    ship(docs.sparkSession)
    buckets = partitions_for(docs.sparkSession)
    corpus = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    answers = answered(asked(docs, order, buckets), buckets)

    def together(used: pa.Table, found: pa.Table) -> pa.Table:
        if used.num_rows != 1:
            raise RuntimeError("a block's documents differ between two scans: write the input to a table first")
        row = used.to_pylist()[0]
        counts, flat = unpack_ints(row["counts"]).astype(np.int64), unpack_ints(row["order"]).astype(np.int64)
        grams = Grams([], 1)
        grams.set(np.split(flat, np.cumsum(counts)[:-1]), np.frombuffer(row["names"], np.uint64), order)
        totals = [np.zeros(len(h), np.int64) for h in grams.hash]
        homes = [bucket_of(h, buckets) for h in grams.hash]
        by = [np.argsort(b, kind="stable") for b in homes]
        ends = [np.cumsum(np.bincount(b, minlength=buckets)) for b in homes]
        seen = 0
        for k, n, data in zip(*(found.column(c).to_pylist() for c in ("bucket", "n", "totals")), strict=True):
            parts = unpack_ints(data).astype(np.int64).reshape(2, -1)
            at = by[n][ends[n][k - 1] if k else 0 : ends[n][k]]
            if len(at) != parts.shape[1]:
                raise RuntimeError("a block's n-grams differ between two scans: write the input to a table first")
            totals[n][at] = parts[0] + (parts[1] << 32)
            seen += len(at)
        if seen != sum(map(len, totals)):
            raise RuntimeError("a block's n-grams differ between two scans: write the input to a table first")
        total, full = log_scores(grams, totals, corpus, backoff)
        cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(counts), pa.array(full.astype(np.int64)), pa.array(total)]
        return pa.table(cols, names=["doc_id", "n_words", "n_matched", "log_score"])

    left = used_words(docs).groupBy("block")
    scored = left.cogroup(answers.groupBy("block")).applyInArrow(together, "doc_id long, n_words long, n_matched long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return scored.withColumn("mean_log_score", mean)
