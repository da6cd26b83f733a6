"""Counts over whole texts that the quality operators share, for a batch of
texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textmill.llm.common import hash128, rolling_hashes, split_words, starts_in_document

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: Words of a window for repeats within one text.
REPEAT_WORDS = 8


def _count(texts: list[str], letters: str) -> np.ndarray:
    """How many characters of each text are among ``letters``."""
    return np.array([sum(map(t.count, letters)) for t in texts], np.int64)


def _same_next(offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before."""
    same = np.zeros(len(index) + 1, np.int64)
    same[2:] = np.cumsum(index[1:] == index[:-1]) if len(index) > 1 else 0
    first = np.minimum(offsets[:-1] + 1, offsets[1:])  # a text's first word has none before it
    return same[offsets[1:]] - same[first]


def repeat_words(offsets: np.ndarray, words: pa.DictionaryArray, width: int = REPEAT_WORDS) -> np.ndarray:
    """Words of each text in windows of ``width`` words found twice or more in it, the first included."""
    own = words.dictionary.to_pylist()
    starts = starts_in_document(offsets, width)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    keys = rolling_hashes(hash128(own)[:, 0][np.asarray(words.indices)], width)[starts]
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[starts]
    keys += document.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)  # equal only within one text
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    edges = np.zeros(int(offsets[-1]) + width + 1, np.int32)
    edges[starts[found]] += 1
    edges[starts[found] + width] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[: int(offsets[-1])] > 0)])
    return np.diff(covered[offsets])


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text; a null text counts as empty."""
    texts = pc.fill_null(texts, "")
    offsets, words = split_words(texts)
    own = texts.to_pylist()
    lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in own]
    chars = np.array([len(t) for t in own], np.int64)
    return {
        "n_words": np.diff(offsets),
        "word_chars": chars - _count(own, SPACES),
        "n_symbols": _count(own, SYMBOLS),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeat_words(offsets, words),
        "n_same_next": _same_next(offsets, np.asarray(words.indices)),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_chars": chars,
        "n_upper": _count(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": _count(own, "0123456789"),
        "n_marks": _count(own, ".,;:'\"()-"),
        "n_shouts": _count(own, "!?"),
    }


#: Names and order of the counts.
COUNTS = list(text_stats(pa.array([], pa.string())))
