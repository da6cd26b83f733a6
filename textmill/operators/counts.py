"""Aggregations.

Counting per document is done inside the document row with array code
when the term list is a fixed small list: a document is already one row,
so there is no shuffle at all.  Counting over the corpus (per term) is
explode + groupBy, which Spark aggregates partially on the map side before
the shuffle, so a term holding a third of all tokens costs one partial row
per task, not a third of the data in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import arrays as A
from textmill.functions import text as T

#: Characters whose n-grams are counted together in a task.
COUNTED_CHARS = 1_000_000


def _counted_ngrams(texts: list, n: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(n-grams, occurrences, texts that hold them) of some texts."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    begin = np.flatnonzero(of[:len(of) - n + 1] == of[n - 1:]) if len(of) >= n else np.zeros(0, np.int64)
    if not len(begin):
        return [], begin, begin
    known = np.zeros(int(points.max()) + 1, np.int64)
    known[points] = 1
    letters = int(known.sum())
    char = (np.cumsum(known) - 1)[points]
    code, top = char[begin], letters
    for k in range(1, n):
        if top * letters * len(texts) >= 2 ** 63:  # number what there is
            found, code = np.unique(code, return_inverse=True)
            top = len(found)
        code, top = code * letters + char[begin + k], top * letters
    own, first, cnt = np.unique(code * len(texts) + of[begin], return_index=True, return_counts=True)
    start = np.flatnonzero(np.diff(own // len(texts), prepend=-1))
    return ([whole[p:p + n] for p in begin[first[start]].tolist()], np.add.reduceat(cnt, start), np.diff(np.append(start, len(own))))


def char_ngram_counts(docs: DataFrame, text: str, lo: int, hi: int) -> DataFrame:
    """(ngram, n, cnt, n_docs): the corpus's character n-grams (``char_ngrams``
    of each text, without making them rows or arrays).  A task counts them over
    whole documents, about ``COUNTED_CHARS`` characters at a time; one row a
    distinct n-gram of these moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(texts):
            for n in range(lo, hi + 1):
                grams, cnt, n_docs = _counted_ngrams(texts, n)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([n] * len(grams), pa.int64()), pa.array(cnt, pa.int64()),
                                                  pa.array(n_docs, pa.int64())], names=["ngram", "n", "cnt", "n_docs"])

        held, size = [], 0
        for batch in batches:
            for t in batch.column("t").drop_null().to_pylist():
                held.append(t)
                size += len(t)
                if size >= COUNTED_CHARS:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    parts = docs.select(T.ngram_text(F.col(text)).alias("t")).mapInArrow(run, "ngram string, n long, cnt long, n_docs long")
    return parts.groupBy("ngram", "n").agg(F.sum("cnt").alias("cnt"), F.sum("n_docs").alias("n_docs"))


def _lit_array(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in sorted(set(terms))])


def lexicon_hits(tokens: Column, terms: list[str]) -> Column:
    lex = _lit_array(terms)
    return F.filter(tokens, lambda t: F.array_contains(lex, t))


def lexicon_counts(df: DataFrame, tokens: str, terms: list[str], key: str = "id") -> DataFrame:
    """(id, term, n) for every lexicon term present in the document; the
    count is computed inside the row (no join, no shuffle)."""
    hits = lexicon_hits(F.col(tokens), terms)
    per_term = F.transform(F.array_distinct(hits),
                           lambda h: F.struct(h.alias("term"),
                                              F.size(F.filter(hits, lambda x: x == h)).cast("long").alias("n")))
    return df.select(key, A.explode(per_term).alias("c")).select(key, "c.term", "c.n")


def lexicon_totals(df: DataFrame, tokens: str, terms: list[str], key: str = "id",
                   out: str = "total", keep: list[str] | None = None) -> DataFrame:
    """Row sum of ``lexicon_counts``; documents without a hit keep 0.
    ``keep`` carries other columns of the row along (no join back)."""
    return df.select(key, *(keep or []), F.size(lexicon_hits(F.col(tokens), terms)).cast("long").alias(out))


def vocabulary_counts(df: DataFrame, tokens: str, vocab: DataFrame, key: str = "id",
                      term: str = "term") -> DataFrame:
    """Per-document counts of a data-derived vocabulary (size not known in
    advance): explode, equi-join (AQE picks broadcast from the measured size,
    else sort-merge with skew splitting), then partial aggregation."""
    # count per (document, term) first: the key includes the document, so a
    # frequent term is spread over tasks, and the join sees distinct rows
    ex = df.select(key, A.explode(F.col(tokens)).alias(term))
    per_doc = ex.groupBy(key, term).agg(F.count("*").alias("n"))
    return per_doc.join(vocab.select(term).distinct(), term, "left_semi").select(key, term, "n")


def unigram_counts(df: DataFrame, tokens: str, out: str = "token") -> DataFrame:
    return df.select(A.explode(F.col(tokens)).alias(out)).groupBy(out).agg(F.count("*").alias("n"))


def value_counts(values: DataFrame, col: str) -> DataFrame:
    return values.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(col))


def group_sizes(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def group_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """Group size over the total.  The total is one aggregate row joined
    back by broadcast (size one by construction)."""
    g = df.groupBy(*cols).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return (g.join(F.broadcast(total), how="inner")
            .select(*cols, "n", (F.col("n") / F.col("__total")).alias("share")))


def group_pivot(df: DataFrame, row: str, col: str, values: list, share: bool = False) -> DataFrame:
    """Counts by two keys, the second spread to columns (value list given,
    so no extra job to find it)."""
    p = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    p = p.na.fill(0, subset=[str(v) for v in values])
    if share:
        total = df.agg(F.count("*").alias("__total"))
        p = p.join(F.broadcast(total), how="inner")
        p = p.select(row, *[(F.col(str(v)) / F.col("__total")).alias(str(v)) for v in values])
    return p


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def max_len(df: DataFrame, tokens: str, cap: int = 100) -> DataFrame:
    return df.agg(F.least(F.max(F.size(tokens)), F.lit(cap)).cast("long").alias("max_len"))
