"""Operator 5, quality rules with adaptive thresholds.

For each language and source, the values of each ratio go into a mergeable
quantile sketch: counts of logarithmic buckets, whose quantiles are within
``ACCURACY`` of the exact ones.  Sketches merge by adding counts.  A group's
habit is the share of its texts with a value over zero and the quartiles of
those values; habits are shrunk by weights n / (n + k) from the group to its
language and from that to the corpus.  The limits follow from the habit, and a
joined filter applies them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import named, row_of, written
from textmill.llm.text_stats import COUNTS, text_stats

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Texts that a language's (or the corpus's) habit counts for in a group.
PRIOR_TEXTS = 50
#: The fixed base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Rule:
    """If ``z`` is the share of texts with a value over zero, z * z is the
    chance that two texts of a group have one.  With that weight the limit is
    ``spread`` times the upper quartile of the values over zero, and with the
    rest of the weight ``strange``, what is still let pass where the others
    have none.  If ``low``, the lower quartile over ``spread`` is a limit too."""

    over: str
    under: str
    spread: float
    strange: float
    low: bool = False


RULES = {
    "symbols": Rule("n_symbols", "n_words", 3, 0.1),
    "dup_lines": Rule("n_dup_lines", "n_lines", 3, 0.4),
    "same_next": Rule("n_same_next", "n_words", 6, 0.15),
    "word_length": Rule("word_chars", "n_words", 1.3, 7.0, low=True),
}


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns in a struct ``row``, and the counts of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                stats = text_stats(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(stats[c], pa.int64()) for c in COUNTS]], names=["row", *COUNTS])

    rows = docs.select(row_of(docs.columns).alias("row"), named(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in COUNTS]]))


def _ratio(rule: Rule) -> Column:
    return F.col(rule.over) / F.greatest(F.col(rule.under), F.lit(1))


def sketches(counted: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rule, bucket, c): the mergeable sketches of all ratios.  Bucket
    b > null holds values in (GAMMA**(b - 1), GAMMA**b]; zero has no bucket."""
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), _ratio(r).alias("value")) for k, r in RULES.items()])).alias("x")
    bucket = F.when(F.col("x.value") > 0, F.ceil(F.log("x.value") / math.log(GAMMA))).cast("int")
    return counted.select(*groups, rules).select(*groups, "x.rule", bucket.alias("bucket")).groupBy(*groups, "rule", "bucket").agg(F.count("*").alias("c"))


def habits(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rule, n, some, z, q25, q75) of sketches merged by ``groups``:
    texts, texts with a value over zero, their share, and the logarithms of
    those values' quartiles (a value stands for its bucket's middle)."""
    merged = sketch.groupBy(*groups, "rule", "bucket").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*groups, "rule")  # at most a few thousand buckets
    nonzero = F.when(F.col("bucket").isNotNull(), F.col("c"))
    ranked = merged.select("*", F.sum("c").over(w).alias("n"), F.coalesce(F.sum(nonzero).over(w), F.lit(0)).alias("some"), F.sum(nonzero).over(w.orderBy(F.col("bucket").asc_nulls_first())).alias("upto"))
    value = F.col("bucket") * F.lit(math.log(GAMMA)) + F.lit(math.log(2 / (1 + GAMMA)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("some") * F.lit(q)), value))
    return ranked.groupBy(*groups, "rule").agg(F.first("n").alias("n"), F.first("some").alias("some"), F.first(F.col("some") / F.col("n")).alias("z"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def _shrunk(value: str, n: str, towards: str) -> Column:
    """``value`` with weight n / (n + PRIOR_TEXTS), the rest from ``towards``."""
    own = F.col(n) / (F.col(n) + PRIOR_TEXTS)
    return own * F.coalesce(F.col(value), F.lit(0.0)) + (1 - own) * F.coalesce(F.col(towards), F.lit(0.0))


_SHAPE = {"z": "n", "q25": "some", "q75": "some"}


def _towards(own: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The habits ``own``, shrunk towards those of ``other`` with the same ``keys``."""
    other = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in _SHAPE])
    same = [own[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return own.join(other, same).select(*[c for c in own.columns if c not in _SHAPE], *[_shrunk(c, n, f"_{c}").alias(c) for c, n in _SHAPE.items()])


def limits(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, <rule>_low, <rule>_high), one row a group."""
    sketch = written(sketches(counted, [lang, source]), "sketch")
    own, by_lang, whole = (habits(sketch, g) for g in ([lang, source], [lang], []))
    x = _towards(own, _towards(by_lang, whole, ["rule"]), [lang, "rule"])
    out = []
    for name, rule in RULES.items():
        here, both = F.col("rule") == name, F.col("z") * F.col("z")
        high = (1 - both) * F.lit(float(rule.strange)) + both * F.lit(float(rule.spread)) * F.exp("q75")
        out.append(F.max(F.when(here, high)).alias(f"{name}_high"))
        if rule.low:
            out.append(F.max(F.when(here, both * F.exp("q25") / F.lit(float(rule.spread)))).alias(f"{name}_low"))
    return x.groupBy(lang, source).agg(*out)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def judge(counted: DataFrame, limit: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``, by a join with its group's limits."""
    limit = limit.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *[c for c in limit.columns if c not in (lang, source)])
    joined = counted.join(limit, counted[lang].eqNullSafe(limit["_lang"]) & counted[source].eqNullSafe(limit["_source"]), "left")
    fails = base_failed()
    for name, rule in RULES.items():
        fails = fails | (_ratio(rule) > F.col(f"{name}_high"))
        if rule.low:
            fails = fails | (_ratio(rule) < F.col(f"{name}_low"))
    kept = [c for c in counted.columns]
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.coalesce(fails, base_failed())).select(*kept, "base_failed", "kept")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``id_col``, ``lang``, ``source``, the counts of each whole text, ``base_failed`` and ``kept``.

    Null texts count as empty; null languages and sources are groups of their
    own; repeated rows are judged alike; an empty table gives an empty one."""
    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang).alias("lang"), named(source).alias("source"))
    counted = with_counts(slim).select(F.col("row.id").alias(id_col), "row.lang", "row.source", *COUNTS)
    counted = written(counted, "counts")
    return judge(counted, limits(counted))


def filter_quality(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns.  Texts
    are counted twice rather than moved: the limits, one row for each language
    and source, come to the documents."""
    counted = with_counts(docs, text_col).select("row", F.col("row").getField(lang).alias("lang"), F.col("row").getField(source).alias("source"), *COUNTS)
    limit = written(limits(counted.drop("row")), "limits")
    return judge(counted, limit).where("kept").select("row.*")
