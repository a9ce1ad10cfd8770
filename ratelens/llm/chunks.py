"""Texts as chunks that byte-level vocabularies tokenize independently.

A chunk runs from a space that a non-space character follows to the next such
space.  The byte-level pattern always starts a match at such a space, and what
precedes it splits as it would at the text's end.  So a text's pre-tokens are
its chunks' pre-tokens in order, and each distinct chunk needs to be split once.

A chunk's key is the chunk without its leading space, or NUL and the chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beyond ASCII.
WIDE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space that starts no chunk, or what the short form of keys can't hold.
UNUSUAL = rf" (?:[\x09-\x0d\x1c-\x20{WIDE}]|\z)|\x00"


def strings(column: pa.Array) -> pa.StringArray:
    """Binary texts as strings; null is empty, invalid UTF-8 is replaced."""
    column = column.fill_null(b"")
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in column.to_pylist()], pa.string())


def unusual_keys(text: str) -> list[str]:
    """Keys of a text with runs of white space or NUL."""
    first, *rest = text.split(" ")
    out = [first] if first else []
    for p in rest:
        if out and (not p or p[0].isspace()):
            out[-1] += " " + p  # this space belongs to a run of white space
        else:
            out.append(" " + p)
    return ["\0" + p for p in out]


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key


def starts_match(chunk: str) -> bool:
    """Whether the chunk starts with a match's space, so that any chunk may stand before it."""
    return chunk[:1] == " " and chunk[1:2] != "" and not chunk[1].isspace()


def chunk_numbers(texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct keys, the key number of every chunk, each text's end among the chunks)."""
    odd = pc.match_substring_regex(texts, UNUSUAL)
    marked = pc.binary_join_element_wise(pa.scalar("\0"), texts, pa.scalar(""))
    if not pc.any(odd).as_py():
        lists = pc.split_pattern(marked, " ")
        flat, lens = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    else:
        parts, lens = [pa.array([], pa.string())], np.zeros(len(texts), np.int64)
        flags = odd.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(flags.astype(np.int8))) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if flags[a]:
                lists = pa.array([unusual_keys(t) for t in texts.slice(a, b - a).to_pylist()], pa.list_(pa.string()))
            else:
                lists = pc.split_pattern(marked.slice(a, b - a), " ")
            parts.append(lists.flatten())
            lens[a:b] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = pa.concat_arrays(parts)
    numbered = flat.dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(zero_copy_only=False), np.cumsum(lens)
