"""Operator 6, quality classifier by Bradley-Terry pairwise ranking: scores
are learned from preference pairs (a good and a bad document) by logistic loss
on the differences of their features, then cut at a quantile of the scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import written
from textmill.llm.quality_rules import with_counts
from textmill.llm.text_stats import COUNTS

#: The fit uses at most so many labelled rows (chosen by a hash of their id) and
#: preference pairs; both bound the driver's memory.
MAX_LABELLED, MAX_PAIRS = 20_000, 200_000
RIDGE, STEPS = 1e-3, 30


def features() -> dict[str, Column]:
    """What a score is made of, from the counts of a text alone."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    cut = lambda x, most: F.least(x, F.lit(float(most)))
    length = per("word_chars", "n_words")
    return {
        "symbols": cut(per("n_symbols", "n_words"), 3), "any_symbols": cut(per("n_symbols", "n_words"), 0.2),
        "repeats": per("n_repeat_words", "n_words"), "any_repeats": cut(per("n_repeat_words", "n_words"), 0.35),
        "dup_lines": per("n_dup_lines", "n_lines"), "any_dup_lines": cut(per("n_dup_lines", "n_lines"), 0.4),
        "same_next": cut(per("n_same_next", "n_words"), 0.15),
        "upper": cut(per("n_upper", "n_chars"), 0.25), "shouts": cut(per("n_shouts", "n_words"), 0.25),
        "digits": cut(per("n_digits", "n_chars"), 0.1), "marks": cut(per("n_marks", "n_words"), 0.5),
        "word_length": F.abs(F.when(F.col("n_words") > 0, length).otherwise(5.0) - F.lit(5.0)),
        "words": F.log1p(F.col("n_words")),
    }


def held_out(id_col: str) -> Column:
    """Whether a row is kept for the test: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 6) -> tuple[np.ndarray, float, float]:
    """(weights, threshold, scale) from rows of features and their labels: a
    Newton fit of P(good beats bad) = 1 / (1 + exp(-w(x_good - x_bad))), then
    the score quantile that best parts the rows."""
    if not len(x) or good.all() or not good.any():
        return np.zeros(x.shape[1]), 0.0, 1.0
    spread = np.maximum(x.std(axis=0), 1e-9)
    z, r = x / spread, np.random.default_rng(seed)
    pairs = min(MAX_PAIRS, 20 * len(x))
    d = z[r.choice(np.flatnonzero(good), pairs)] - z[r.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the wrong order
        gradient = d.T @ p / pairs - RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ w
    levels = np.unique(np.quantile(scores, np.linspace(0, 1, 1001)))
    cuts = (levels[1:] + levels[:-1]) / 2 if len(levels) > 1 else levels
    right = [((scores >= c) == good).mean() for c in cuts]
    cut = float(cuts[int(np.argmax(right))])
    return w / spread, cut, float(max(scores.std(), 1e-9) / 4)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1, at least 0.5 means good)
    and ``predicted`` for every document, learned from the labelled rows that
    are not held out.

    Null and empty texts are scored like any other.  Rows without a label or
    an id teach nothing; with no rows of one of the classes every score is
    0.5.  Repeated rows get equal scores."""
    own = features()
    slim = docs.select(F.col(id_col), F.col(text_col))
    counted = with_counts(slim, text_col).select(F.col("row").getField(id_col).alias(id_col), *COUNTS)
    table = written(counted.select(id_col, *[c.alias(k) for k, c in own.items()]), "features")
    marked = labels.select(F.col(id_col), F.col(label).alias("label")).where("label is not null").where(~held_out(id_col))
    taught = written(table.join(marked, id_col), "labelled")
    # Take about a tenth more than the bound by hash first, or each task would send its own MAX_LABELLED rows.
    share = min(1.0, 1.1 * MAX_LABELLED / max(1, taught.count()))
    some = taught.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.orderBy(F.xxhash64(id_col, F.lit(1)), *[F.col(k) for k in own], "label").limit(MAX_LABELLED)
    rows = rows.select("label", *own).toPandas()
    w, cut, scale = fit(rows[list(own)].to_numpy(float), rows["label"].to_numpy() == 1)
    raw = sum((F.lit(float(a)) * F.col(k) for k, a in zip(own, w)), F.lit(0.0))
    score = 1 / (1 + F.exp((F.lit(cut) - raw) / F.lit(scale)))
    return table.select(id_col, held_out(id_col).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
