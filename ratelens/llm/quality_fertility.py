"""Quality rules: tokenizer fertility.

Public vocabularies measure each text:

* ``chars_per_token``: code points of words per token of a byte-level BPE,
* ``byte_share``: share of byte-fallback tokens under a vocabulary with byte
  fallback,
* ``token_entropy``: Shannon entropy (bits) of the text's byte-BPE tokens,
* ``symbols_per_word``: symbols, which split words into more tokens, per word.

Each measure has a rejection band per script (the script of most letters,
numbers and signs not counted:
latin, cyrillic, greek, arabic, hebrew, cjk, other).  A text outside a band of
its script is rejected.  The bands are fixed parameters, so a text's verdict
does not depend on the rest of the table and nothing is shuffled.

Beside them the base counts: words, code points in words, symbols, duplicate
lines and words in repeated three-word windows.  A text with fewer than
``min_words`` words, or with over half of its words in repeated windows, fails.

Each distinct word is tokenized once per Python worker.  Defined results: a
null text counts as one without words (base_failed); empty texts fail; very
long texts are measured whole; repeated rows are judged each; clashing columns
are not touched (``judge`` returns its own columns, ``keep`` those of the input).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratelens.llm.shared import Numbering, ragged, read_file, ship, trim, worker_cache

#: Least and most of each measure, by script; None: no bound.
#: Entropy is compared for texts of at least 100 tokens.
BANDS = {
    "latin": {"chars_per_token": (1.3, 9.0), "byte_share": (None, 0.2), "token_entropy": (3.0, None), "symbols_per_word": (None, 0.1)},
    "cyrillic": {"chars_per_token": (0.4, 6.0), "byte_share": (None, 0.3), "token_entropy": (3.0, None), "symbols_per_word": (None, 0.1)},
    "greek": {"chars_per_token": (0.4, 6.0), "byte_share": (None, 0.3), "token_entropy": (3.0, None), "symbols_per_word": (None, 0.1)},
    "arabic": {"chars_per_token": (0.4, 6.0), "byte_share": (None, 0.4), "token_entropy": (3.0, None), "symbols_per_word": (None, 0.1)},
    "hebrew": {"chars_per_token": (0.4, 6.0), "byte_share": (None, 0.4), "token_entropy": (3.0, None), "symbols_per_word": (None, 0.1)},
    "cjk": {"chars_per_token": (0.3, 4.0), "byte_share": (None, 0.6), "token_entropy": (3.0, None), "symbols_per_word": (None, 0.1)},
    "other": {"chars_per_token": (0.2, 9.0), "byte_share": (None, 0.9), "token_entropy": (2.0, None), "symbols_per_word": (None, 0.1)},
}
#: Code point ranges of the scripts' letters.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏḀ-ỿ",
    "cyrillic": "Ѐ-ԯ",
    "greek": "Ͱ-Ͽἀ-῿",
    "arabic": "؀-ۿݐ-ݿ",
    "hebrew": "֐-׿",
    "cjk": "぀-ヿ㐀-鿿가-힯",
}
SCRIPT_OF = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
ENTROPY_TOKENS = 100
KEPT_WORDS = 400_000
#: More of them don't outlive a task.
IDLE_WORDS = 50_000

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, symbols_per_word double, script string, "
    "base_failed boolean, kept boolean"
)
TYPES = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


class WordMeasures:
    """Per distinct word: code points, byte-BPE ids, tokens and byte-fallback tokens, letters by script."""

    def __init__(self, bpe: bytes, fallback: bytes) -> None:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=fallback)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.reset()

    def reset(self) -> None:
        self.numbers = Numbering()
        self.ids = np.zeros(0, np.int64)
        self.table = np.zeros((0, 5), np.int64)  # code points, ids, first id, pieces, byte pieces
        self.script = np.zeros((0, len(SCRIPTS)), np.int64)

    def number(self, words: list[bytes]) -> np.ndarray:
        return self.numbers.of(words)

    def measure_new(self) -> None:
        new = [w.decode("utf-8", "replace") for w in self.numbers.order[len(self.table) :]]
        if not new:
            return
        ids = [self.bpe.encode_ordinary(" " + w) for w in new]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        found = self.pieces.encode(new, num_threads=1)
        n_pieces = np.fromiter(map(len, found), np.int64, len(found))
        flags = self.is_byte[np.fromiter((i for x in found for i in x), np.int64, int(n_pieces.sum()))].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(flags)])
        ends = np.cumsum(n_pieces)
        rows = np.empty((len(new), 5), np.int64)
        rows[:, 0] = np.fromiter(map(len, new), np.int64, len(new))
        rows[:, 1] = lens
        rows[:, 2] = len(self.ids) + np.cumsum(lens) - lens
        rows[:, 3] = n_pieces
        rows[:, 4] = sums[ends] - sums[ends - n_pieces]
        scripts = np.zeros((len(new), len(SCRIPTS)), np.int64)
        for k, w in enumerate(new):
            if w.isascii():
                scripts[k, 0] = len(w) if w.isalpha() else len(SCRIPT_OF["latin"].findall(w))
            else:
                scripts[k] = [len(p.findall(w)) for p in SCRIPT_OF.values()]
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.int64, int(lens.sum()))])
        self.table = np.concatenate([self.table, rows])
        self.script = np.concatenate([self.script, scripts])


def repeated_words(numbers: np.ndarray, size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first included."""
    n = len(numbers) - size + 1
    if n < 2:
        return 0
    _, code = np.unique(numbers, return_inverse=True)
    top = int(code.max()) + 1
    window = code[:n].astype(np.int64)
    for k in range(1, size):
        window = window * top + code[k : k + n]
        if k < size - 1 and top**3 >= 1 << 62:
            _, window = np.unique(window, return_inverse=True)
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    cover = np.zeros(len(numbers), bool)
    at = np.flatnonzero(count[back] > 1)
    for k in range(size):
        cover[at + k] = True
    return int(cover.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    count = np.unique(ids, return_counts=True)[1]
    return float(np.log2(len(ids)) - (count * np.log2(count)).sum() / len(ids))


def within(bands: dict, script: str, n_tokens: int, measures: dict[str, float]) -> bool:
    for name, (least, most) in bands[script].items():
        if name == "token_entropy" and n_tokens < ENTROPY_TOKENS:
            continue
        if (least is not None and measures[name] < least) or (most is not None and measures[name] > most):
            return False
    return True


def judge(
    docs: DataFrame, bpe_path: str, fallback_path: str, bands: dict | None = None, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id and the measures and verdict of every row (columns MEASURES)."""
    return _measured(docs.select("doc_id", "text"), bpe_path, fallback_path, bands or BANDS, min_words, None)


def keep(docs: DataFrame, bpe_path: str, fallback_path: str, bands: dict | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and no other."""
    return _measured(docs, bpe_path, fallback_path, bands or BANDS, min_words, docs.schema)


def _measured(docs, bpe_path, fallback_path, bands, min_words, schema) -> DataFrame:
    ship(docs.sparkSession)
    bpe, fallback = read_file(bpe_path), read_file(fallback_path)
    names = [c.split() for c in MEASURES.split(", ")]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_cache("word measures", lambda: WordMeasures(bpe, fallback))
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rows = measured(m, part.column(at).cast(pa.binary()).to_pylist(), bands, min_words)
                if schema is not None:
                    yield part.filter(pa.array([r[-1] for r in rows], pa.bool_()))
                else:
                    cols = [pa.array(c, TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *(n for n, _ in names)])
        if len(m.numbers.order) > IDLE_WORDS:
            # an idle worker keeps the vocabularies only
            m.reset()
            trim()

    return docs.mapInArrow(run, schema if schema is not None else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def measured(m: WordMeasures, texts: list[bytes | None], bands: dict, min_words: int) -> list[tuple]:
    if len(m.numbers.order) > KEPT_WORDS:
        m.reset()
    numbered = [m.number(t.split()) if t else np.zeros(0, np.int64) for t in texts]
    m.measure_new()
    rows = []
    for text, words in zip(texts, numbered, strict=True):
        text = text or b""
        table = m.table[words]
        ids = ragged(m.ids, m.table[:, 2], m.table[:, 1], words)
        n, chars, tokens, pieces = len(words), int(table[:, 0].sum()), len(ids), int(table[:, 3].sum())
        letters = m.script[words].sum(axis=0)
        script = list(SCRIPTS)[int(letters.argmax())] if letters.any() else "other"
        repeats = repeated_words(words)
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        measures = {
            "chars_per_token": chars / tokens if tokens else 0.0,
            "byte_share": int(table[:, 4].sum()) / pieces if pieces else 0.0,
            "token_entropy": entropy(ids),
            "symbols_per_word": symbols / n if n else 0.0,
        }
        failed = n < min_words or 100 * repeats > 50 * n
        kept = not failed and within(bands, script, tokens, measures)
        rows.append((n, chars, symbols, duplicate_lines(text), repeats, tokens, *measures.values(), script, failed, kept))
    return rows
