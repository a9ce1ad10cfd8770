"""Byte-level BPE over a global shuffle of distinct words.

Encoding:

1. Texts are cut into the pattern's matches (pre-tokens) and each pre-token's
   position is kept as its number among the block's distinct pre-tokens.
2. The blocks' distinct pre-tokens are shuffled by their hash; a task encodes
   each distinct pre-token it holds once, by merging ranks.
3. The ids go back to the blocks, and each document's ids are put together by
   position.

A pre-token that occurs in every document is sent once per block, not once per
occurrence, so no key holds more rows than there are blocks.  Decoding looks
the ids up in the token-byte table (as many rows as the vocabulary has, so a
copy goes to each task) and joins the bytes.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded each; very long texts are whole in one block and a
pre-token of any length is one key; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.blocks import blocks
from ratelens.llm.chunks import chunk_numbers, chunk_of, starts_match, strings
from ratelens.llm.shared import Numbering, pack_ints, partitions_for, ragged, read_file, ship, unpack_ints, with_text

#: Text bytes of a block: larger blocks send a word less often and take more memory.
BLOCK_BYTES = 16 << 20

_kept: dict = {}


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}


class WordEncoder:
    """Ids of single pre-tokens by merging ranks."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(vocabulary), special_tokens={}).encode_ordinary

    def all(self, words: list[bytes]) -> list[list[int]]:
        return [self.encode(w.decode()) for w in words]


class Splitter:
    """A block's texts as numbers of distinct pre-tokens; each distinct chunk is matched once."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall

    def block(self, texts: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
        """(distinct pre-tokens, each text's pre-token numbers)."""
        keys, idx, ends = chunk_numbers(strings(pa.array(texts, pa.binary())))
        distinct = list(map(chunk_of, keys))
        # chunks that start at a space can be matched in one go: each starts a match
        joint = np.fromiter(map(starts_match, distinct), bool, len(distinct))
        word = Numbering()
        found = self.find("".join([c for c, j in zip(distinct, joint, strict=True) if j]))
        numbers = word.of(found)
        own = np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct)) * joint)
        lens = np.zeros(len(distinct), np.int64)
        at = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), own[joint], side="right")
        lens[joint] = np.diff(at, prepend=0)
        starts = np.zeros(len(distinct), np.int64)
        starts[joint] = at - lens[joint]
        more = []
        for k in np.flatnonzero(~joint).tolist():
            alone = word.of(self.find(distinct[k]))
            lens[k] = len(alone)
            more.append(alone)
        sizes = np.fromiter(map(len, more), np.int64, len(more))
        starts[~joint] = len(numbers) + np.cumsum(sizes) - sizes
        numbers = np.concatenate([numbers, *more]).astype(np.int32)
        tokens = np.concatenate([[0], np.cumsum(lens[idx])])
        return word.order, np.split(ragged(numbers, starts, lens, idx), tokens[ends[:-1]])


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """block, no, word: the blocks' distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        for block, _, texts in blocks(batches, BLOCK_BYTES):
            words, _ = split.block(texts)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), block)),
                        pa.array(np.arange(at, at + len(part), dtype=np.int32)),
                        pa.array([w.encode() for w in part], pa.binary()),
                    ],
                    ["block", "no", "word"],
                )

    return with_text(docs).mapInArrow(run, "block long, no int, word binary")


def positions(docs: DataFrame, pattern: str) -> DataFrame:
    """block, doc_ids, counts, order: which distinct pre-token stands at each position of the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        for block, ids, texts in blocks(batches, BLOCK_BYTES):
            words, used = split.block(texts)
            counts = np.fromiter(map(len, used), np.uint32, len(used))
            order = np.concatenate([np.zeros(0, np.int32), *used])
            row = [
                pa.array([block]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([pack_ints(counts)], pa.binary()),
                pa.array([pack_ints(order)], pa.binary()),
                pa.array([len(words)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "counts", "order", "n_words"])

    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return with_text(ids).mapInArrow(run, "block long, doc_ids array<long>, counts binary, order binary, n_words long")


def encoded_words(words: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """block, nos, lens, ids: the distinct words' ids, each word encoded once where its hash lives."""
    hashed = words.repartition(partitions_for(words.sparkSession), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in _kept:
            _kept["encoder"] = WordEncoder(vocabulary, pattern)
        encoder, known, flat, lens, rows = _kept["encoder"], Numbering(), [], [], []
        for batch in batches:
            at = known.of(batch.column(2).to_pylist())
            for ids in encoder.all(known.order[len(lens) :]):
                lens.append(len(ids))
                flat += ids
            rows.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), at))
        if not rows:
            return
        block, no, at = (np.concatenate([r[k] for r in rows]) for k in range(3))
        n = np.array(lens, np.int64)
        ids, starts = np.array(flat, np.uint32), np.cumsum(n) - n
        order = np.lexsort((no, block))
        block, no, at = block[order], no[order], at[order]
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[a : a + 1]),
                    pa.array([pack_ints(no[a:b])], pa.binary()),
                    pa.array([pack_ints(n[at[a:b]])], pa.binary()),
                    pa.array([pack_ints(ragged(ids, starts, n, at[a:b]))], pa.binary()),
                ],
                ["block", "nos", "lens", "ids"],
            )

    return hashed.mapInArrow(run, "block long, nos binary, lens binary, ids binary")


class Decoder:
    """The token-byte table."""

    def __init__(self, vocabulary: bytes) -> None:
        self.get = {r: w for w, r in ranks_of(vocabulary).items()}.__getitem__

    def all(self, ids: list[bytes]) -> pa.Array:
        return pa.array([b"".join(map(self.get, np.frombuffer(x, "<u4").tolist())) for x in ids], pa.binary())


def decoder(vocabulary: bytes) -> Decoder:
    if "decoder" not in _kept:
        _kept["decoder"] = Decoder(vocabulary)
    return _kept["decoder"]


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers); ``decoded`` adds the bytes that these ids decode to."""
    ship(docs.sparkSession)
    vocabulary = read_file(vocabulary_path)
    answers = encoded_words(distinct_words(docs, pattern), vocabulary, pattern)

    def together(order: pa.Table, found: pa.Table) -> pa.Table:
        if not order.num_rows:
            raise RuntimeError("a block has words but no documents: the input changed between two scans")
        row = order.to_pylist()[0]
        size = row["n_words"]
        nos, lens, ids = ([unpack_ints(x) for x in found.column(c).to_pylist()] for c in ("nos", "lens", "ids"))
        none = np.zeros(0, np.uint32)
        no, n, flat = (np.concatenate([none, *x]).astype(np.int64) for x in (nos, lens, ids))
        if order.num_rows != 1 or len(no) != size or (size and (no.max() != size - 1 or len(np.unique(no)) != size)):
            raise RuntimeError("a block's words differ between two scans: write the input to a table first")
        starts, counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        starts[no], counts[no] = np.cumsum(n) - n, n
        used, out, at = unpack_ints(row["order"]), [], 0
        for k in unpack_ints(row["counts"]).tolist():
            out.append(ragged(flat, starts, counts, used[at : at + k].astype(np.int64)).astype("<u4").tobytes())
            at += k
        cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(out, pa.binary())]
        cols += [decoder(vocabulary).all(out)] if decoded else []
        return pa.table(cols, names=["doc_id", "ids", "bytes"][: len(cols)])

    left, right = positions(docs, pattern), answers
    schema = "doc_id long, ids binary" + ", bytes binary" * decoded
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(together, schema)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """The columns of ``encoded`` and ``bytes``: its ids joined with the token-byte table."""
    vocabulary = read_file(vocabulary_path)
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                out = decoder(vocabulary).all(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "bytes"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kept}, bytes binary")


def digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a full round trip."""
    return encode(docs, vocabulary_path, pattern, decoded=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
