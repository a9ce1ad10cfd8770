"""Substring dedup by hashing lines, the sentences inside them, and runs of words.

Units are of three kinds, each of ``min_words`` normalised words or more.  Whole
lines.  Sentences inside a line: such a unit ends with the line, or with a
sentence end (``.``, ``!`` or ``?`` and white space, or a full-width one) once the
unit's last sentence has ``SENTENCE_WORDS`` words, so that short sentences are
part of a longer unit.  And ``RUN_WORDS`` words from each word that the words
alone choose (winnowing: of ``WINDOW`` successive places the one whose three
words hash least, all of them on ties), wherever sentences and lines begin.  A
unit's words are normalised (lower case, only letters and digits, one space
between words) and hashed to 128 bits.  A word is a run of letters and digits,
or one letter of a script that is written without spaces (``SOLO``).

With the default of 20 words a shorter line or sentence that many documents
share (a licence line, a stock phrase) is no repeated passage and stays; ask for
fewer words to take such lines out too.

Texts that share a run of words choose the same places inside it, at most
``WINDOW`` apart.  So of a run of ``RUN_WORDS + WINDOW - 1`` words or more (49)
a later copy keeps fewer than ``WINDOW`` words at each end.  Units overlap; a
word is cut if one unit that holds it occurred before, so each cut word has an
earlier copy that stays.  Of a passage that repeats itself within ``RUN_WORDS``
words the first unit stays whole.

A document is a doc_id and a text (t1, t2: its 128-bit digest).  Of each unit's
digest the earliest occurrence by (doc_id, t1, t2, start) stays.  Every other
occurrence is removed, and its offsets in the original text are kept:

* ``removals``: doc_id, start, end (code points of the original text), the
  digest, where it is kept (first_doc, first_start), and t1, t2,
* ``dedup``:    the documents with these spans cut out.

One aggregation over all units, combined before its shuffle, finds each
digest's first occurrence, its count and, as 64 bits, the salts of its
occurrences (a hash of doc_id and start).  Digests that occur more than once are
joined back to their occurrences by digest and salt, one row for each salt that
they have.  So a line that stands in a third of all rows is spread over 64
joins, and one that stands twice makes two rows at most.

Defined results: null and empty texts have no unit and stay as they are; rows
with a null doc_id rank after all others; repeated rows (same doc_id or none, and
same text) are one document, so their units don't remove each other, and each
gets the same spans removed; rows that share a doc_id, or have none, but differ
in text are documents of their own; ties can't occur within a document as starts differ; an empty table
gives an empty result.  ``dedup`` keeps the input's columns and no other, and
sets ``n_chars``, where there is one, to the text's new length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.shared import free_name, gram_hashes, mix64, release, ship, text_digest, with_text

SENTENCE_WORDS = 4
MIN_WORDS = 20
RUN_WORDS = 30
WINDOW = 20
#: Bits of a long.
SALTS = 64
#: A run of text up to a sentence end, a line end or the text's end.
SENTENCE = re.compile(r"[^\n.!?。！？]*+(?:[.!?]++(?![\s。！？]|\Z)[^\n.!?。！？]*+)*+(?:[.!?。！？]++[^\S\n]*+|\n++|\Z)")
#: Code point ranges of Thai and Lao, Myanmar, Khmer, kana, Han.
SOLO = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))
_SOLO = "".join(f"{chr(a)}-{chr(b)}" for a, b in SOLO)
WORDS = re.compile(rf"[^\W_{_SOLO}]+|(?!_)\w")
LATIN = re.compile(r"[^\n.!?]*+(?:[.!?]++(?!\s|\Z)[^\n.!?]*+)*+(?:[.!?]++[^\S\n]*+|\n++|\Z)"), re.compile(r"[^\W_]+")


def patterns(text: str) -> tuple[re.Pattern, re.Pattern]:
    """``SENTENCE`` and ``WORDS``, or what finds the same faster in a text of one byte a letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return SENTENCE, WORDS
    return LATIN


MULTIPLIER = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words: their letters' polynomial, from the running sum over all words."""
    codes = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    if len(_powers[0]) <= len(codes):
        for k, base in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.full(2 * len(codes), base, np.uint64))
    power, inverse = _powers
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)])])
    return mix64((total[ends] - total[ends - lens]) * inverse[ends - lens])


_letters: list[np.ndarray] = []


def word_spans(text: str) -> np.ndarray:
    """(start, end) of the matches of ``WORDS``."""
    if not _letters:
        kinds = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.int8, 0x110000)
        for a, b in SOLO:
            kinds[a : b + 1] *= 2
        _letters.append(kinds)
    kind = np.zeros(len(text) + 2, np.int8)
    kind[1:-1] = _letters[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    before, after = kind[:-1], kind[1:]
    starts = np.flatnonzero((after == 2) | ((after == 1) & (before != 1)))
    ends = np.flatnonzero((before == 2) | ((before == 1) & (after != 1)))
    return np.stack([starts, ends], 1)


def sliding(best: np.ufunc, a: np.ndarray) -> np.ndarray:
    """``best`` of each ``WINDOW`` successive values."""
    n = 1
    while 2 * n <= WINDOW:
        a, n = best(a[:-n], a[n:]), 2 * n
    return best(a[: len(a) - (WINDOW - n)], a[WINDOW - n :])


def chosen(words: list[str]) -> list[int]:
    """Places that start a run: those with the least hash of ``WINDOW`` successive three-word windows."""
    h = gram_hashes(word_hashes(words), 3)
    most = sliding(np.maximum, np.pad(sliding(np.minimum, h), WINDOW - 1))
    return np.flatnonzero(h[: len(words) - RUN_WORDS + 1] == most[: len(words) - RUN_WORDS + 1]).tolist()


def units(text: str, min_words: int) -> list[tuple[int, int, str]]:
    """(start, end, normalised words) of the units with enough words."""
    lowered = text.lower()
    same = len(lowered) == len(text)
    sentence, pattern = patterns(text)
    found, words = sentences(text, lowered, same, min_words, sentence, pattern)
    if len(words) < RUN_WORDS + WINDOW - 1 or min_words > RUN_WORDS:
        return found
    spans = word_spans(text)
    if len(spans) != len(words):  # letters that are several in lower case
        same, words = False, [text[a:b].lower() for a, b in spans.tolist()]
        if len(words) < RUN_WORDS + WINDOW - 1:
            return found

    def unit(k: int, n: int) -> tuple[int, int, str]:
        a, b = int(spans[k, 0]), int(spans[k + n - 1, 1])
        return a, b, " ".join(words[k : k + n] if same else pattern.findall(text[a:b].lower()))

    every = [(*u, -1) for u in found] + [(*unit(k, RUN_WORDS), k) for k in chosen(words)]
    out, first = [], {}
    for a, b, name, k in sorted(every, key=lambda u: u[0]):
        end, before = first.get(name, (a, -1))
        if a >= end:
            first.setdefault(name, (b, k))
            out.append((a, b, name))
        elif k >= 0 and before >= 0:
            # the first unit of a passage that repeats itself: also with what is left of its last period
            first[name] = end, -1
            period = k - before
            whole = unit(before, -(-RUN_WORDS // period) * period)
            if whole[2] not in first:
                first[whole[2]] = whole[1], -1
                out.append(whole)
    return out


def sentences(text: str, lowered: str, same: bool, min_words: int, sentence: re.Pattern, pattern: re.Pattern) -> tuple[list[tuple[int, int, str]], list[str]]:
    """The units that are lines or sentences inside them, and all words."""
    found, every = [], []
    line = start = 0
    line_at = at = 0  # their places in ``every``
    parts: list[tuple[int, int, int, int]] = []
    for m in sentence.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        new = pattern.findall(lowered, a, b) if same else pattern.findall(text[a:b].lower())
        every += new
        ended = b == len(text) or text[b - 1] == "\n"
        if not ended and len(new) < SENTENCE_WORDS:
            continue
        if len(every) - at >= min_words:
            parts.append((start, b, at, len(every)))
        start, at = b, len(every)
        if ended:
            if len(every) - line_at >= min_words:
                found.append((line, b, " ".join(every[line_at:])))
            # a sentence with all the line's words is the line
            found += [(x, y, " ".join(every[i:j])) for x, y, i, j in parts if j - i < len(every) - line_at]
            line, line_at, parts = b, len(every), []
    return found, every


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """Every unit: h1, h2 (the digest's halves), doc_id, t1, t2 (the text's), start, end."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                h1, h2, rows, starts, ends = [], [], [], [], []
                for row, raw in enumerate(part.column(1).to_pylist()):
                    if not raw:
                        continue
                    for a, b, words in units(raw.decode("utf-8", "replace"), min_words):
                        h = xxhash.xxh3_128_intdigest(words)
                        h1.append((h >> 64) - (1 << 63))
                        h2.append((h & (1 << 64) - 1) - (1 << 63))
                        rows.append(row)
                        starts.append(a)
                        ends.append(b)
                long, at_rows = pa.int64(), pa.array(rows, pa.int64())
                own = [part.column(c).take(at_rows) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1, long), pa.array(h2, long), *own, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    ["h1", "h2", "doc_id", "t1", "t2", "start", "end"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    t1, t2 = text_digest()
    named = docs.select("doc_id", "text", t1.alias("t1"), t2.alias("t2"))
    return with_text(named, "t1", "t2").mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, t1 long, t2 long, start int, end int")


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans to remove: doc_id, start, end, h1, h2, first_doc, first_start, t1, t2."""
    found = occurrences(docs, min_words)
    # null ids rank last
    rank = F.struct(F.col("doc_id").isNull().alias("anon"), "doc_id", "t1", "t2", "start")
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, start), {SALTS}) as int))")
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.bit_or(bit).alias("salts")).where("n > 1")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1)
    both = found.withColumn("salt", salt).join(first.select("h1", "h2", "first", F.explode(salts).alias("salt")), ["h1", "h2", "salt"])
    other = ~reduce(and_, (F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("doc_id", "t1", "t2", "start")))
    return (
        both.where(other)
        .select("doc_id", "start", "end", "h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"), "t1", "t2", "salt")
        .distinct()
        .drop("salt")
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in sorted(spans):
        kept.append(text[at:a])
        at = max(at, b)
    kept.append(text[at:])
    return "".join(kept)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without later occurrences; texts left without a word go (``drop_emptied``)."""
    found = removals(docs, min_words)
    columns, schema = docs.columns, docs.schema
    doc, one, two, cuts = (free_name(columns, c) for c in ("_doc", "_t1", "_t2", "_spans"))
    spans = found.groupBy(F.col("doc_id").alias(doc), F.col("t1").alias(one), F.col("t2").alias(two))
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    t1, t2 = text_digest()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (t1 == F.col(one)) & (t2 == F.col(two))
    joined = docs.join(spans, same, "left").select(*columns, cuts)
    text, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols = list(part.columns)
                texts, lists, keep = cols[text].to_pylist(), cols.pop().to_pylist(), []
                for k, s in enumerate(lists):
                    if s and texts[k] is not None:
                        texts[k] = cut_spans(texts[k], [(x["start"], x["end"]) for x in s])
                    keep.append(not s or not drop_emptied or bool(WORDS.search(texts[k])))
                cols[text] = pa.array(texts, cols[text].type)
                if chars is not None:
                    old = cols[chars].to_pylist()
                    cols[chars] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(texts, lists, old, strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, columns).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document with removed text: doc_id, t1, t2, n_removed, removed_chars, spans (start:end, comma-joined)."""
    found = removals(docs, min_words)
    span = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("start", "end", span.alias("span"))))
    # spans may overlap
    none = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    add = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["at"], x["start"]))).alias("n")
    )
    return found.groupBy("doc_id", "t1", "t2").agg(
        F.count("*").alias("n_removed"),
        F.aggregate(listed, none, add, lambda s: s["n"]).alias("removed_chars"),
        F.concat_ws(",", F.transform(listed, lambda x: x["span"])).alias("spans"),
    )
