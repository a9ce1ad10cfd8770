"""Helpers of the training-data operators.

* ``ship``      sends this package's modules to the executors once per session,
                as ``--py-files`` would.
* ``written``   cuts lineage with a Parquet table in the cluster's shared
                checkpoint folder (``spark.checkpoint.dir``).
* ``Numbering`` and ``ragged``: numpy forms of "look each distinct word up once".
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make ``ratelens`` importable on executors that don't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ratelens-"), "ratelens.zip")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ratelens", os.path.relpath(full, root)))
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is set (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="ratelens-shared-")
        spark.sparkContext.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ratelens-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


_worker: dict = {}


def release() -> None:
    """Drop what earlier operators left in this Python worker, and give the memory back to the system."""
    if _worker:
        _worker.clear()
        trim()


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass


def worker_cache(key: str, make: Callable):
    """What a Python worker keeps from task to task: one object, of the operator that runs."""
    if key not in _worker:
        release()
        _worker[key] = make()
    return _worker[key]


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver and sent with the task's closure."""
    with open(path, "rb") as f:
        return f.read()


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six bytes."""
    return text.split() if text else []


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[i] : starts[i] + lens[i]]`` for each i of ``idx``."""
    n = lens[idx]
    total = int(n.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[idx] - (ends - n), n) + np.arange(total)]


class Numbering(dict):
    """Numbers keys by first appearance; ``order`` lists them."""

    def __init__(self) -> None:
        super().__init__()
        self.order: list = []

    def __missing__(self, key):
        self[key] = n = len(self.order)
        self.order.append(key)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a bijection of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each window of ``n`` words, from the words' 64-bit hashes."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(word_hashes) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + size])
    return h


def pack_ints(a: np.ndarray) -> bytes:
    """32-bit integers by byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_digest() -> tuple[Column, Column]:
    """The halves of a text's digest."""
    return F.xxhash64("text"), F.xxhash64(F.lit(1), "text")


def with_text(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the whole text as bytes and the ``keep`` columns."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *keep)
