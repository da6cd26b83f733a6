"""Operator 9, substring dedup: Rabin-Karp hashes of every fixed-length word
window are counted over the whole corpus, and repeated windows merge into
maximal removal intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textmill.llm.windows import remove_repeated_windows

#: Words of a window.
WINDOW_WORDS = 20


def dedup_substrings(docs: DataFrame, width: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", **work) -> DataFrame:
    """``id_col, n_units, n_removed, kept_text``: each document without the
    words that repeated windows of ``width`` words cover.  Windows are judged
    on the input, so what one document loses does not save another's words.
    Empty, null and short texts lose nothing; see ``remove_repeated_windows``
    for repeated ids, nulls and empty tables."""
    return remove_repeated_windows(docs, "word", width, id_col, text_col, **work)
