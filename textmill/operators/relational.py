"""Projections, filters, predicates and label handling."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.hashing import phash


def prune_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def swap_text_columns(df: DataFrame, translated: str = "translated_text", text: str = "text",
                      original: str = "original_text") -> DataFrame:
    """translated -> text and text -> original in one projection (chained
    renames would collide)."""
    cols = []
    for c in df.columns:
        if c == translated:
            cols.append(F.col(c).alias(text))
        elif c == text:
            cols.append(F.col(c).alias(original))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def filter_language(df: DataFrame, languages: list[str], col: str = "language") -> DataFrame:
    return df.where(F.col(col).isin(languages))


def filter_originals(df: DataFrame) -> DataFrame:
    return df.where(F.col("of_id") == -1)


def filter_group(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def filter_comment_terms(terms: DataFrame, col: str = "term") -> DataFrame:
    return terms.where(~F.col(col).startswith("#"))


def filter_min_freq(counts: DataFrame, limit: int, col: str = "n") -> DataFrame:
    """Keep rows whose count is strictly above ``limit``."""
    return counts.where(F.col(col) > limit)


def filter_tokens(tokens: DataFrame, stopwords: DataFrame | None = None, remove_punct: bool = True,
                  remove_digit: bool = True, remove_pron: bool = False,
                  pos_blacklist: list[str] | None = None) -> DataFrame:
    """Token-table filter.  ``stopwords`` is a small fixed list (broadcast,
    its size is the list's); matched on the lemma."""
    t = tokens
    if remove_punct and "is_punct" in t.columns:
        t = t.where(~F.col("is_punct"))
    if remove_digit:
        t = t.where(~F.col("form").rlike(r"^\p{N}+$"))
    if remove_pron and "pos" in t.columns:
        t = t.where(F.col("pos") != "PRON")
    if pos_blacklist and "pos" in t.columns:
        t = t.where(~F.col("pos").isin(pos_blacklist))
    if stopwords is not None:
        t = t.join(F.broadcast(stopwords.select(F.col("term").alias("lemma"))), "lemma", "left_anti")
    return t


def prefix_columns(df: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    return df.toDF(*[c if c == key else f"{prefix}_{c}" for c in df.columns])


def select_by_prefix(df: DataFrame, prefixes: list[str], keep: list[str] | None = None) -> DataFrame:
    cols = list(keep or []) + [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    return df.select(*cols)


def fill_missing(df: DataFrame, text_value: str = "dontknow", number_value: float = 0) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(text_value, subset=strings).na.fill(number_value, subset=numbers)


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=columns)


def cast_columns(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})


def map_labels(c: Column, mapping: dict) -> Column:
    """Dictionary lookup, unmapped -> null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[c]


def label_dictionary(df: DataFrame, col: str) -> DataFrame:
    """Code book (label, code) from sorted distinct labels.  The distinct
    set is small (class labels); the final window is over it only."""
    d = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return d.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))


def fit_label_encoder(df: DataFrame, col: str, out: str = "code"):
    """Alphabetical integer codes, fitted once and reused for every split."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc",
                         handleInvalid="keep").fit(df)


def decode_labels(df: DataFrame, model, col: str = "code", out: str = "label") -> DataFrame:
    return IndexToString(inputCol=col, outputCol=out, labels=model.labels).transform(df)


def binarize_multiclass(c: Column, negative, positive=1) -> Column:
    """Every class except the negative one becomes the positive class."""
    return F.when(c == F.lit(negative), F.lit(negative)).otherwise(F.lit(positive))


def one_hot(df: DataFrame, col: str, levels: list[str], drop: str = "first", prefix: str | None = None) -> DataFrame:
    """One column per level from the sorted level list.  ``drop='first'``
    drops the first level; ``'if_binary'`` drops one only for two levels.
    Unknown levels are an error (``raise_error`` at run time)."""
    lv = sorted(levels)
    keep = lv[1:] if (drop == "first" or (drop == "if_binary" and len(lv) == 2)) else lv
    p = prefix or col
    known = F.col(col).isin(lv) | F.col(col).isNull()
    checked = F.when(known, F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown level in {col}: "), F.col(col))))
    return df.select("*", *[(checked == F.lit(v)).cast("double").alias(f"{p}_{v}") for v in keep])


def passthrough_columns(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    return df.select(key, *columns)


def sample_rows(df: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """n rows in seeded hash order (a top-n by hash: each task keeps its own
    n best, then one merge of n x tasks rows)."""
    return df.orderBy(phash(key, seed=seed), F.col(key)).limit(n)
