"""Fill-in-middle transformation by in-place block rotation.

A text is cut at two token borders into prefix, middle and suffix.  The
sentinels go into one ``bytearray`` of the whole text, and the segments change
places by a rotation of three reversals, each in place.  ``restore`` finds the
sentinels, rotates back and takes them out, so it gives the text exactly.

* A token is white space with the word after it, or the white space that ends
  the text; a cut of c units lies behind the c-th token.  All token borders
  come from one numpy scan of the text's bytes: a border follows each byte of a
  word that no byte of a word follows.  The six white space bytes are ASCII, so
  bytes and code points give the same borders.
* Cuts, form and order come from a SHA-256 of the seed and the document's id:
  they don't depend on partitions, and a task that runs again gives them again.
* A text that contains a sentinel stays plain, so sentinels can be found
  without doubt.  (Every sentinel starts with its only ``<`` and ends with its
  only ``>``, so none arises where segments meet.)

Memory: a task holds one slice of ``SLICE_ROWS`` rows, and about ten bytes for
each byte of the one text it scans, whatever the table's size.

Defined results: a null text is an empty one; empty texts are plain with n = 0;
a null doc_id hashes like an empty one; string ids hash as they are; equal
doc_ids get equal hashes, and their texts are cut each by its own length;
repeated rows give repeated results; an empty table gives an empty result;
very long texts are cut whole, like short ones (a single text must fit in an
Arrow batch, 2 GB).  Of the input only doc_id and the columns named in ``keep``
are carried; a kept name that the result uses raises a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.shared import free_name, ship

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Rows that a task turns into Python objects at once.
SLICE_ROWS = 200
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def token_ends(text: bytes) -> np.ndarray:
    """Where each token ends: behind every word, and at the end of a text that ends in white space."""
    if not text:
        return np.zeros(0, np.int64)
    word = ~_SPACE[np.frombuffer(text, np.uint8)]
    last = np.empty(len(word), bool)
    np.logical_not(word[1:], out=last[:-1])
    last[:-1] &= word[:-1]
    last[-1] = True
    return np.flatnonzero(last) + 1


def _reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse ``view[start:end]`` by exchanging its halves."""
    half = (end - start) // 2
    if half:
        front, back = view[start : start + half], view[end - half : end]
        kept = front[::-1].copy()
        front[:] = back[::-1]
        back[:] = kept


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the blocks ``[start, cut)`` and ``[cut, end)`` in place: three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, cut)
    _reverse(view, cut, end)
    _reverse(view, start, end)


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text``, cut at two byte offsets, in the order of ``form`` (spm or psm)."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def rebuild(output: bytes, form: str) -> bytes:
    """The text that ``arrange`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    size = len(buffer)
    if form == "psm":
        start, moved = buffer.index(SUFFIX), buffer.index(MIDDLE)
    else:
        start, moved = 0, buffer.index(PREFIX)
    suffix = moved - start
    rotate(buffer, start, moved, size)
    middle = buffer.index(MIDDLE)
    end = size - suffix
    del buffer[end : end + len(SUFFIX)]
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


def chars(text: bytes) -> int:
    """Code points of UTF-8 bytes: those that don't continue a character."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def transform_text(doc: str, text: bytes, seed: int, rate: int, spm: int) -> tuple:
    """(n, form, prefix code points, middle code points, output) of one text."""
    digest = hashlib.sha256(f"{seed}:{doc}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    ends = token_ends(text)
    n = len(ends)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = int(ends[one - 1]) if one else 0
    second = int(ends[two - 1]) if two else 0
    out = bytes(arrange(text, first, second, form))
    return n, form, chars(text[:first]), chars(text[first:second]), out


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, keep: Sequence[str] = ()
) -> DataFrame:
    """doc_id, the ``keep`` columns, n, form, prefix_chars, middle_chars and output (binary).

    ``rate`` per cent of the texts are rearranged, ``spm`` per cent of them
    with the suffix first.
    """
    clash = {c.lower() for c in keep} & {"doc_id", *RESULT}
    if clash:
        raise ValueError(f"kept column(s) {sorted(clash)} clash with the result's")
    ship(docs.sparkSession)
    body, key = (free_name(["doc_id", *keep], c) for c in ("_body", "_key"))
    rows = docs.select(
        "doc_id",
        F.col("text").cast("binary").alias(body),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key),
        *keep,
    )
    doc, _, _, *kept = rows.schema.fields
    schema = T.StructType(
        [
            T.StructField("doc_id", doc.dataType),
            *kept,
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                keys, texts = part.column(2).to_pylist(), part.column(1).to_pylist()
                made = [transform_text(k, t or b"", seed, rate, spm) for k, t in zip(keys, texts, strict=True)]
                n, form, prefix, middle, out = zip(*made, strict=True)
                columns = [part.column(0), *(part.column(i) for i in range(3, part.num_columns))]
                columns += [pa.array(n, pa.int64()), pa.array(form, pa.string())]
                columns += [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, name: str = "restored") -> DataFrame:
    """``rows`` (with form and output) and the text as bytes in a new column ``name``."""
    if name.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"column {name} exists")
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])
    form_at, out_at = rows.columns.index("form"), rows.columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                pairs = zip(part.column(out_at).to_pylist(), part.column(form_at).to_pylist(), strict=True)
                texts = pa.array([rebuild(o, f) for o, f in pairs], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=schema.names)

    return rows.mapInArrow(run, schema)
