"""Views over the driver tables in the reference's data model.

posts      documents left join labels: id, source, language, text, split
           ('train' when labelled, else 'test'), task1 (binary), task2
           (four classes from quality x toxic)
social     posts whose text carries a mention, a hashtag, a MENTIONn tag, a
           link and an emoji (the driver text has none of those)
tokens     one row per word: (doc_id, sent_id, i, form, lemma, head); sentences
           split on line ends and . ! ?; head is a deterministic surrogate
           tree (a real parse drops in with the same schema)

Every view reads the whole table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import arrays as A

from textmill.functions import text as T
from textmill.sources.files import table

# ---------------------------------------------------------------------------
# Small input lexicons.  Real words of the driver corpus stand
# in for the reference's lexicon files (same role, same size class).
# ---------------------------------------------------------------------------
HEDGES = ["is", "that", "it", "for", "was", "#comment"]
BOOSTERS = ["the", "of", "and", "this", "are"]
MALE = ["der", "den", "von", "le", "les", "el", "los"]
FEMALE = ["die", "das", "la", "une", "las", "una"]
STOPWORDS = ["the", "of", "and", "to", "in", "de", "la", "le", "der", "die", "und", "que", "el",
             "et", "les", "des", "en", "is", "it", "that"]
# Valence lexicon (token, valence on the -4..4 scale), negations and boosters.
VALENCE = [("good", 1.9), ("the", 0.2), ("of", -0.1), ("and", 0.4), ("is", 0.6), ("that", -0.8),
           ("was", -0.5), ("with", 0.9), ("are", 1.1), ("this", -1.2), ("de", 0.3), ("la", -0.4),
           ("und", 0.7), ("der", -0.6), ("que", 1.3), ("le", -1.5)]
NEGATIONS = ["not", "no", "nicht", "pas", "never"]
CONTRASTS = ["but", "aber", "mais", "pero"]
VALENCE_BOOSTERS = [("very", 0.293), ("most", 0.293), ("by", 0.293), ("on", -0.293)]
# Multi-word phrases for the dictionary matcher, with their group label.
PHRASES = [("of the", "FUNC"), ("in the", "FUNC"), ("the", "ART"), ("la", "ART"),
           ("der", "ART"), ("die", "ART"), ("it is", "FUNC"), ("de la", "FUNC")]
# Class names of the four-class label (quality * 2 + toxic).
TASK2_NAMES = ["low-clean", "low-toxic", "high-clean", "high-toxic"]
TASK1_NAMES = {0: "non-toxic", 1: "toxic"}
# ---------------------------------------------------------------------------


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", ["doc_id", "source", "lang", "text"])
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    code = F.col("quality") * 2 + F.col("toxic")
    t2 = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(TASK2_NAMES))):
        t2 = F.when(code == i, F.lit(name)).otherwise(t2)
    return (d.join(lab, "doc_id", "left")
            .select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("language"), "text",
                    F.when(F.col("toxic").isNull(), "test").otherwise("train").alias("split"),
                    F.when(F.col("toxic") == 1, TASK1_NAMES[1]).when(F.col("toxic") == 0, TASK1_NAMES[0])
                    .alias("task1"),
                    t2.alias("task2")))


def posts_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, task1, task2) of the labelled posts, without the text."""
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    code = F.col("quality") * 2 + F.col("toxic")
    t2 = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(TASK2_NAMES))):
        t2 = F.when(code == i, F.lit(name)).otherwise(t2)
    return lab.select(F.col("doc_id").alias("id"),
                      F.when(F.col("toxic") == 1, TASK1_NAMES[1]).when(F.col("toxic") == 0, TASK1_NAMES[0])
                      .alias("task1"), t2.alias("task2"))


def decorate(id_col, text_col):
    """Mention, hashtag, MENTIONn tag, link and emoji around the text."""
    return F.concat(F.lit("RT @u"), (id_col % 7).cast("string"), F.lit(": "), text_col,
                    F.lit(" #Tag"), (id_col % 11).cast("string"), F.lit(" MENTION"),
                    (id_col % 5).cast("string"), F.lit(" http://x.org/p/"), id_col.cast("string"),
                    F.lit("?a=1 \U0001F600"))


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return p.withColumn("text", decorate(F.col("id"), F.col("text")))


def social_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, decorated text) straight from the documents: queries that need
    no label never join (and so never move) the text."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("id"), decorate(F.col("doc_id"), F.col("text")).alias("text"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"),
                       A.posexplode(F.split(F.col(text_col), r"[.!?\n]+")).alias("sent_id", "sentence"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word table with a surrogate dependency tree:
    head(0) = null, head(i) = greatest(0, i - 1 - i % 2)."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    s = sentences(d)
    w = s.select("doc_id", "sent_id", A.posexplode(T.word_tokens(F.col("sentence"))).alias("i", "form"))
    return w.select("doc_id", "sent_id", "i", "form", F.col("form").alias("lemma"),
                    F.when(F.col("i") == 0, F.lit(None).cast("int"))
                    .otherwise(F.greatest(F.lit(0), F.col("i") - 1 - F.col("i") % 2)).alias("head"))


def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tokens`` as sentences (doc_id, sent_id, t), never taken apart.  Words are
    found before the explode, as a filter on them would find them again."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    head = lambda i: F.when(i > 0, F.greatest(F.lit(0), i - 1 - i % 2))
    words = F.transform(F.split(F.col("text"), r"[.!?\n]+"), lambda x: T.word_tokens(x))
    s = d.select("doc_id", A.posexplode(words).alias("sent_id", "w")).where(F.size("w") > 0)
    t = F.transform("w", lambda w, i: F.struct(i.alias("i"), w.alias("form"), w.alias("lemma"), head(i).cast("int").alias("head")))
    return s.select("doc_id", "sent_id", t.alias("t"))


def doc_tokens(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """(id, tokens ARRAY<STRING>) per document, whole text."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    txt = T.clean_text(F.col("text")) if clean else F.col("text")
    return d.select(F.col("doc_id").alias("id"), T.word_tokens(txt).alias("tokens"))


def lexicon_df(spark: SparkSession, terms: list[str], name: str = "lexicon") -> DataFrame:
    return spark.createDataFrame([(name, t) for t in terms], "lexicon string, term string")
