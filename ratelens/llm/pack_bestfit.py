"""Best-fit packing by a linear grouping scheme.

Pieces of at most ``capacity`` tokens are packed into few sequences:

1. Large pieces (over ``capacity / share``) are sorted by length and cut
   into groups of equal cardinality; each length is rounded up to its group's
   largest.  Few sizes remain.
2. Configurations over these few sizes are built one after another: a knapsack
   over the capacity that must hold the largest size left, used as often as the
   groups allow.
3. Actual pieces take the slots of the configurations; what rounding wasted
   becomes room again.
4. Small pieces go, longest first, to the fullest sequence that has room.

A few layouts (share and number of groups) are planned and the best is taken.

The plan needs the pieces' lengths alone: a histogram of at most ``capacity``
counts goes to the driver, and the plan comes back as runs of ranks (pieces
``from <= rank < to`` of one length go to consecutive sequences).  Its size
depends on the capacity, not on the number of documents.  Tokenizing, ranking
and placing are Spark jobs; a piece's rank among its length is a counter of its
task plus an offset from one small count table.

Defined results: a null text is an empty one; an empty document is the single
token ``end_id``; repeated rows are packed each; ties in length go by task and
place in the input; an empty table gives an empty result; columns of the input
other than doc_id and text are not carried.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.chunks import chunk_numbers, chunk_of, starts_match, strings
from ratelens.llm.shared import Numbering, ragged, read_file, ship, with_text, worker_cache, written

CAPACITY = 2048
#: Layouts tried, the one with fewest sequences wins: pieces over capacity / share
#: are large, and are cut into so many groups.
LAYOUTS = ((2, 50), (3, 200), (3, 1000), (4, 1000))
#: Distinct text chunks whose ids a Python worker keeps.
KEPT_CHUNKS = 600_000
#: Chunks encoded as one string.
JOINED = 64


class ChunkEncoder:
    """Token ids of texts, encoding each distinct chunk once.

    A text's ids are its chunks' ids in order (see ``chunks``).  Chunks used again are kept from block to
    block, up to half of KEPT_CHUNKS.
    """

    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.tokenizer.encode_special_tokens = True
        words = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(words.values()) + 1, np.int64)
        for word, k in words.items():
            self.token_bytes[k] = len(word)  # one character stands for one byte
        self.numbers = Numbering()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.lens, self.starts, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > KEPT_CHUNKS // 2:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT_CHUNKS // 2])
        flat = ragged(self.flat, self.starts, self.lens, keep)
        order = self.numbers.order
        self.numbers = Numbering()
        self.numbers.of([order[k] for k in keep.tolist()])
        self.lens, self.uses = self.lens[keep], self.uses[keep] // 2
        self.starts, self.flat, self.used = np.cumsum(self.lens) - self.lens, flat, len(flat)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids in a row, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum())), lens

    def _add(self, new: list[str]) -> None:
        """Encode new chunks: those that start at a space in strings of JOINED, cut again by their bytes."""
        joint = np.fromiter(map(starts_match, new), bool, len(new))
        run = [c for c, j in zip(new, joint.tolist(), strict=True) if j]
        flat, _ = self._ids(["".join(run[k : k + JOINED]) for k in range(0, len(run), JOINED)])
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in run), np.int64, len(run)))
        lens = np.zeros(len(new), np.int64)
        lens[joint] = np.diff(np.searchsorted(np.cumsum(self.token_bytes[flat]), ends) + 1, prepend=0)
        rest, lens[~joint] = self._ids([c for c, j in zip(new, joint.tolist(), strict=True) if not j])
        starts = np.zeros(len(new), np.int64)
        for part, base in ((joint, 0), (~joint, len(flat))):
            starts[part] = base + np.cumsum(lens[part]) - lens[part]
        total = len(flat) + len(rest)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used) + total, np.uint32)])
        self.flat[self.used : self.used + total] = np.concatenate([flat, rest])
        self.starts = np.concatenate([self.starts, self.used + starts])
        self.lens = np.concatenate([self.lens, lens])
        self.used += total

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        if len(self.numbers.order) > KEPT_CHUNKS:
            self._shrink()
        keys, idx, ends = chunk_numbers(texts)
        known = self.numbers.of(keys)
        new = self.numbers.order[len(self.lens) :]
        if new:
            self._add([chunk_of(k) for k in new])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[known] += np.bincount(idx, minlength=len(keys))
        used = known[idx]
        tokens = np.concatenate([[0], np.cumsum(self.lens[used])])
        return np.split(ragged(self.flat, self.starts, self.lens, used), tokens[ends[:-1]])


def encoder(vocabulary: bytes) -> ChunkEncoder:
    return worker_cache(f"chunks {zlib.crc32(vocabulary)}", lambda: ChunkEncoder(vocabulary))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"
PIECES_IDS = PIECES + ", ids binary"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: bytes, capacity: int, end_id: int, ids: bool) -> DataFrame:
    """The documents' pieces, each with its rank among its task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out: list[tuple] = []
                for doc, found in zip(part.column(0).to_pylist(), enc.encode(strings(part.column(1))), strict=True):
                    data = np.append(found, np.uint32(end_id)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(data), capacity)):
                        raw = data[s : s + n].tobytes()
                        row = (doc, k, s, n, zlib.crc32(raw), task, int(seen[n]))
                        out.append((*row, raw) if ids else row)
                        seen[n] += 1
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), *[pa.binary()] * ids]
                names = [x.split()[0] for x in (PIECES_IDS if ids else PIECES).split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return with_text(docs).mapInArrow(run, PIECES_IDS if ids else PIECES)


Run = tuple[int, int, int, int, int, int]


def best_plan(counts: np.ndarray) -> list[Run]:
    """The plan with fewest sequences among LAYOUTS."""
    return min((plan(counts, *layout) for layout in LAYOUTS), key=lambda p: p[0])[1]


def plan(counts: np.ndarray, share: int, n_groups: int) -> tuple[int, list[Run]]:
    """The number of sequences, and runs (length, from, to, first sequence, per sequence, offset) for ``counts[length]`` pieces.

    The k-th piece of a run goes to sequence ``first + k // per`` at
    ``offset + k % per * length``.
    """
    capacity = len(counts) - 1
    runs: list[Run] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, count)
    sequences = 0

    # 1. equal-cardinality groups of the large lengths, each a descending list of (length, from, to)
    large = [n for n in range(capacity, capacity // share, -1) if counts[n]]
    total = int(sum(counts[n] for n in large))
    each = max(1, -(-total // n_groups))
    groups: list[list[tuple[int, int, int]]] = []
    left = 0
    for n in large:
        at = 0
        while at < counts[n]:
            if left == 0:
                groups.append([])
                left = each
            take = min(left, int(counts[n]) - at)
            groups[-1].append((n, at, at + take))
            at, left = at + take, left - take
    sizes = [g[0][0] for g in groups]
    remaining = [sum(b - a for _, a, b in g) for g in groups]

    def take(g: int, n: int) -> list[tuple[int, int, int]]:
        """The next ``n`` actual pieces of a group."""
        got = []
        while n:
            length, a, b = groups[g][0]
            k = min(n, b - a)
            got.append((length, a, a + k))
            n -= k
            if a + k == b:
                groups[g].pop(0)
            else:
                groups[g][0] = (length, a + k, b)
        return got

    # 2. configurations; 3. actual pieces in their slots
    while any(remaining):
        config = fullest(sizes, remaining, capacity)
        times = min(remaining[g] // n for g, n in config.items())
        slots = [take(g, times) for g, n in config.items() for _ in range(n)]
        for g, n in config.items():
            remaining[g] -= n * times
        done = 0
        while done < times:
            k = min(s[0][2] - s[0][1] for s in slots)
            offset = 0
            for s in slots:
                length, a, b = s[0]
                runs.append((length, a, a + k, sequences + done, 1, offset))
                offset += length
                if a + k == b:
                    s.pop(0)
                else:
                    s[0] = (length, a + k, b)
            room[capacity - offset].append((sequences + done, k))
            done += k
        sequences += times

    # 4. small pieces, best fit
    for length in range(capacity // share, 0, -1):
        at, need, r = 0, int(counts[length]), length
        while need:
            while r <= capacity and not room[r]:
                r += 1
            if r > capacity:
                per = capacity // length
                bins = -(-need // per)
                room[capacity].append((sequences, bins))
                sequences += bins
                r = capacity
            first, bins = room[r].pop()
            per = min(r // length, max(1, need // bins)) if need >= bins else 1
            k = min(bins, -(-need // per))
            n = min(need, k * per)
            runs.append((length, at, at + n, first, per, capacity - r))
            full = n // per
            if full:
                room[r - per * length].append((first, full))
            if n % per:
                room[r - n % per * length].append((first + full, 1))
            if k < bins:
                room[r].append((first + k, bins - k))
            at, need = at + n, need - n
            r = length
    return sequences, runs


def fullest(sizes: list[int], remaining: list[int], capacity: int) -> dict[int, int]:
    """Counts by group that hold the largest size left and fill the capacity best."""
    first = next(g for g, n in enumerate(remaining) if n)
    inside = (1 << (capacity + 1)) - 1
    sums = [1 << sizes[first]]  # bit c: the groups before g can make c
    for g in range(first, len(sizes)):
        step = made = sums[-1]
        for _ in range(min(remaining[g] - (g == first), capacity // sizes[g])):
            step = step << sizes[g] & inside
            made |= step
        sums.append(made)
    at, uses = sums[-1].bit_length() - 1, {first: 1}
    for g in range(len(sizes) - 1, first - 1, -1):
        while not sums[g - first] >> at & 1:
            at -= sizes[g]
            uses[g] = uses.get(g, 0) + 1
    return uses


def placed(ranked: DataFrame, runs: list[Run], capacity: int) -> DataFrame:
    """Rows with ``length`` and ``_rank`` get ``sequence_id`` and ``offset`` from the plan's runs."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    # length and rank as one ascending key: ranks of a length start at its base
    ends = np.zeros(capacity + 2, np.int64)
    np.maximum.at(ends, table[:, 0] + 1, table[:, 2])
    base = np.cumsum(ends)
    lower = base[table[:, 0]] + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            r = table[np.searchsorted(lower, base[length] + rank, side="right") - 1]
            k = rank - r[:, 1]
            cols = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_rank"]
            names = [n for n in batch.schema.names if n != "_rank"]
            cols += [pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``ids=True`` adds each piece's token ids as little-endian 32-bit integers.
    """
    ship(docs.sparkSession)
    cutup = written(pieces(docs, read_file(vocabulary_path), capacity, end_id, ids))
    by_task = cutup.groupBy("length", "_task").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = cutup.join(offsets, ["length", "_task"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), F.col("_rank").cast("long").alias("_rank")
    )
    return placed(ranked, best_plan(counts), capacity)
