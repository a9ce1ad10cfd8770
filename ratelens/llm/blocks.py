"""Blocks of documents and their distinct keys, shared by the n-gram and byte-pair operators.

A scan of the same table gives each task the same rows in the same order, so a
task's documents can be cut into the same blocks in two scans: one sends each
block's distinct keys to the tasks that hold the keys' hashes, the other keeps
the order in which documents use them.  Only distinct keys of a block and the
answers to them are shuffled, each once.  Consumers check that both sides of a
block agree and raise if they don't (the input must be a table, not a frame
whose rows may come in another order when a task runs again).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block number, doc_ids, texts) of a task; a block closes after ``block_bytes`` of text."""
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield number, ids, texts
                    number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts
