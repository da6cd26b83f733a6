"""Operator 7, line dedup: overlapping windows of three lines are hashed,
repeated windows are found over the whole corpus, and later occurrences go by
merging the positions that they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textmill.llm.windows import remove_repeated_windows

#: Lines of a window.
WINDOW_LINES = 3


def dedup_lines(docs: DataFrame, width: int = WINDOW_LINES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), **work) -> DataFrame:
    """``id_col, n_units, n_removed, kept_text``: each document without the
    lines of windows that start earlier elsewhere.  Lines are compared as they
    are; only lines with a word count, and blank lines are left in place.
    Texts with fewer than ``width`` such lines lose nothing; see
    ``remove_repeated_windows`` for repeated ids, nulls and empty tables."""
    return remove_repeated_windows(docs, "line", width, id_col, text_col, carry, **work)
