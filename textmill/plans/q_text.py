"""Queries for the scalar text functions and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import arrays as A

from textmill.functions import text as T
from textmill.operators import counts as C
from textmill.plans import corpus
from textmill.plans import sqlparts as S
from textmill.plans.registry import query
from textmill.sources.files import table


def R6(c):
    return F.round(c, 6) + F.lit(0.0)


# ---------------------------------------------------------------- flagship
@query("lexicon_by_class", f"""
WITH {S.POSTS},
tok AS (SELECT id, task2, {S.word_tokens(S.clean_text('text'))} AS tokens FROM posts WHERE task2 IS NOT NULL)
SELECT task2, count(*) AS n_docs,
       CAST(sum(len(list_filter(tokens, lambda t: list_contains({S.lit_list(corpus.BOOSTERS)}, t)))) AS BIGINT) AS hits,
       round(avg(len(list_filter(tokens, lambda t: list_contains({S.lit_list(corpus.BOOSTERS)}, t)))), 6) + 0.0 AS avg_total
FROM tok GROUP BY task2""")
def lexicon_by_class(spark, sf_dir):
    """Clean documents, count a lexicon per document, join labels, average
    the count by class."""
    # Each document is reduced to (id, total) where it is read, so the join
    # with the labels moves two numbers per document, never the text.
    tok = corpus.doc_tokens(spark, sf_dir)
    tot = C.lexicon_totals(tok, "tokens", corpus.BOOSTERS)
    lab = corpus.posts_labels(spark, sf_dir).where(F.col("task2").isNotNull())
    return (tot.join(lab, "id").groupBy("task2")
            .agg(F.count("*").alias("n_docs"), F.sum("total").cast("long").alias("hits"),
                 R6(F.avg("total")).alias("avg_total")))


# ---------------------------------------------------------------- cleaning
def _social_text(spark, sf_dir, fn):
    s = corpus.social_text(spark, sf_dir)
    return s.select("id", fn(F.col("text")).alias("text"))


@query("strip_emoji", f"WITH {S.SOCIAL} SELECT id, {S.strip_emoji('text')} AS text FROM social")
def strip_emoji(spark, sf_dir):
    return _social_text(spark, sf_dir, T.strip_emoji)


@query("strip_hashtags", f"WITH {S.SOCIAL} SELECT id, {S.strip_hashtags('text')} AS text FROM social")
def strip_hashtags(spark, sf_dir):
    return _social_text(spark, sf_dir, T.strip_hashtags)


@query("strip_mentions", f"WITH {S.SOCIAL} SELECT id, {S.strip_mentions('text')} AS text FROM social")
def strip_mentions(spark, sf_dir):
    return _social_text(spark, sf_dir, T.strip_mentions)


@query("strip_urls", f"WITH {S.SOCIAL} SELECT id, {S.strip_urls('text')} AS text FROM social")
def strip_urls(spark, sf_dir):
    return _social_text(spark, sf_dir, T.strip_urls)


@query("remove_spans", r"""SELECT doc_id AS id,
  regexp_replace(text, '(\p{L})(\p{N}+)', '\1', 'g') AS text FROM documents""")
def remove_spans(spark, sf_dir):
    """Delete digit runs that follow a letter, keep the letter."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("id"), T.remove_spans(F.col("text"), r"(\p{L})(\p{N}+)", "$1").alias("text"))


@query("normalize_space", f"SELECT doc_id AS id, {S.normalize_space('text')} AS text FROM documents")
def normalize_space(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("id"), T.normalize_space(F.col("text")).alias("text"))


@query("strip_markup", f"SELECT page_id, {S.normalize_space(S.strip_markup('html'))} AS text FROM pages")
def strip_markup(spark, sf_dir):
    p = table(spark, sf_dir, "pages", ["page_id", "html"])
    return p.select("page_id", T.normalize_space(T.strip_markup(F.col("html"))).alias("text"))


@query("clean_text", f"WITH {S.SOCIAL} SELECT id, {S.clean_text('text')} AS text FROM social")
def clean_text(spark, sf_dir):
    return _social_text(spark, sf_dir, T.clean_text)


@query("clean_text_light", f"WITH {S.SOCIAL} SELECT id, {S.clean_text_light('text')} AS text FROM social")
def clean_text_light(spark, sf_dir):
    return _social_text(spark, sf_dir, T.clean_text_light)


@query("strip_punctuation", r"SELECT doc_id AS id, regexp_replace(text, '\p{P}', '', 'g') AS text FROM documents")
def strip_punctuation(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("id"), T.strip_punctuation(F.col("text")).alias("text"))


# ---------------------------------------------------------------- tokens
@query("word_tokens", f"""SELECT doc_id AS id, CAST(len({S.word_tokens('text')}) AS BIGINT) AS n_tokens,
  array_to_string({S.word_tokens('text')}, ' ') AS tokens FROM documents""")
def word_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    t = T.word_tokens(F.col("text"))
    return d.select(F.col("doc_id").alias("id"), F.size(t).cast("long").alias("n_tokens"),
                    F.array_join(t, " ").alias("tokens"))


_SOC = r"(^|[^\p{L}\p{N}_])[@#][\p{L}\p{N}_]"


@query("social_tokens", f"""WITH {S.SOCIAL}
SELECT id,
  CAST(len(regexp_extract_all(lower(text), '{S.W}{{2,}}'))
       - len(regexp_extract_all(lower(text), '{_SOC}{{2,}}'))
       + len(regexp_extract_all(lower(text), '{_SOC}+')) AS BIGINT) AS n_tokens,
  CAST(len(regexp_extract_all(lower(text), '{_SOC}+')) AS BIGINT) AS n_social
FROM social""")
def social_tokens(spark, sf_dir):
    s = corpus.social_text(spark, sf_dir)
    t = T.social_tokens(F.col("text"))
    return s.select("id", F.size(t).cast("long").alias("n_tokens"),
                    F.size(F.filter(t, lambda x: x.startswith("@") | x.startswith("#"))).cast("long").alias("n_social"))


@query("content_tokens", f"""
SELECT doc_id AS id, array_to_string(list_filter({S.word_tokens(S.clean_text('text'))},
   lambda t: NOT list_contains({S.lit_list(corpus.STOPWORDS)}, t) AND NOT regexp_full_match(t, '\\p{{N}}+')), ' ') AS text
FROM documents""")
def content_tokens(spark, sf_dir):
    """Clean, lower-case, drop stopwords and digit tokens, join by space.
    Lemma = form here (no tagger); a token table with lemmas drops in."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    stop = F.array(*[F.lit(w) for w in sorted(set(corpus.STOPWORDS))])
    toks = T.word_tokens(T.clean_text(F.col("text")))
    kept = F.filter(toks, lambda t: ~F.array_contains(stop, t) & ~t.rlike(r"^\p{N}+$"))
    return d.select(F.col("doc_id").alias("id"), F.array_join(kept, " ").alias("text"))


@query("char_ngrams", r"""
WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[\s\x{0B}\x{85}\p{Z}][\s\x{0B}\x{85}\p{Z}]+', ' ', 'g') AS s FROM documents),
g AS (SELECT doc_id, substring(s, p, n) AS ngram, n
      FROM t, (VALUES (3), (4)) v(n), LATERAL (SELECT unnest(range(1, length(s) - n + 2)) AS p))
SELECT ngram, CAST(n AS BIGINT) AS n, count(*) AS cnt, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY ngram, n""")
def char_ngrams(spark, sf_dir):
    """Corpus table of character 3- and 4-grams: occurrences and document
    frequency (the vocabulary statistics the vectoriser needs)."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return C.char_ngram_counts(d, "text", 3, 4)


@query("extract_hashtags", f"""WITH {S.SOCIAL}
SELECT id, unnest(regexp_extract_all(text, '#{S.W}+')) AS tag FROM social""")
def extract_hashtags(spark, sf_dir):
    s = corpus.social_text(spark, sf_dir)
    return s.select("id", A.explode(T.extract_hashtags(F.col("text"))).alias("tag"))


@query("extract_mentions", f"""WITH {S.SOCIAL}
SELECT id, unnest(regexp_extract_all(text, '@{S.W}+')) AS mention FROM social""")
def extract_mentions(spark, sf_dir):
    s = corpus.social_text(spark, sf_dir)
    return s.select("id", A.explode(T.extract_mentions(F.col("text"))).alias("mention"))


@query("count_hashtags", f"""WITH {S.SOCIAL}
SELECT id, CAST(len(regexp_extract_all(text, '{S.HASHTAG}')) AS BIGINT) AS hashtag_count FROM social""")
def count_hashtags(spark, sf_dir):
    s = corpus.social_text(spark, sf_dir)
    return s.select("id", T.count_hashtags(F.col("text")).cast("long").alias("hashtag_count"))


@query("count_mentions", f"""WITH {S.SOCIAL}
SELECT id, CAST(len(regexp_extract_all(text, '{S.MENTION}')) AS BIGINT) AS mention_count FROM social""")
def count_mentions(spark, sf_dir):
    s = corpus.social_text(spark, sf_dir)
    return s.select("id", T.count_mentions(F.col("text")).cast("long").alias("mention_count"))


@query("mask_terms", f"SELECT doc_id AS id, {S.mask_terms('text', corpus.MALE + corpus.FEMALE)} AS text FROM documents")
def mask_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("id"), T.mask_terms(F.col("text"), corpus.MALE + corpus.FEMALE).alias("text"))


@query("zero_pad", """SELECT doc_id AS id, printf('%06d', doc_id) AS padded,
  printf('%06d', doc_id * 10007) AS padded_big FROM documents""")
def zero_pad(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id"])
    return d.select(F.col("doc_id").alias("id"), T.zero_pad(F.col("doc_id")).alias("padded"),
                    T.zero_pad(F.col("doc_id") * 10007).alias("padded_big"))


@query("canonical_array", f"""SELECT item_id, array_to_string(list_sort({S.word_tokens('text')}), ' ') AS canon
FROM benchmark""")
def canonical_array(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return b.select("item_id", F.array_join(T.canonical_array(T.word_tokens(F.col("text"))), " ").alias("canon"))


@query("compose_key", f"WITH {S.POSTS} SELECT id, language || '_' || task2 AS key FROM posts WHERE task2 IS NOT NULL")
def compose_key(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("task2").isNotNull())
    return p.select("id", T.compose_key(F.col("language"), F.col("task2")).alias("key"))
