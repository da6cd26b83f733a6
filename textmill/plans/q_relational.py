"""Queries for sources, projections, labels, joins on keys, counts,
windows, top-k and set operations (SURVEY 2.1-2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import arrays as A

from textmill.functions import text as T
from textmill.operators import counts as C
from textmill.operators import joins as J
from textmill.operators import relational as RL
from textmill.operators import setops as SO
from textmill.operators import windows as WN
from textmill.plans import corpus
from textmill.plans import sqlparts as S
from textmill.plans.registry import query
from textmill.session import cut_lineage
from textmill.sources.files import flatten_terms, table


def R6(c):
    return F.round(c, 6) + F.lit(0.0)


GENDERED = corpus.MALE + corpus.FEMALE
TASK2_CODE = {n: i for i, n in enumerate(sorted(corpus.TASK2_NAMES))}


def reference_items(spark, sf_dir):
    """Benchmark sentences as labelled reference items: originals
    (of_id = -1) plus a masked modification of each (of_id = original)."""
    b = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    orig = b.select(F.col("item_id").alias("id"), F.lit("benchmark").alias("dataset"), "text",
                    F.lit(-1).cast("long").alias("of_id"))
    mod = b.select((F.col("item_id") + 1000000).alias("id"), F.lit("masked").alias("dataset"),
                   T.mask_terms(F.col("text"), GENDERED).alias("text"), F.col("item_id").alias("of_id"))
    return orig.unionByName(mod)


def translated_posts(spark, sf_dir):
    """Posts with a ``translated_text`` column from ``translate_lookup``."""
    p = corpus.posts(spark, sf_dir)
    return J.translate_lookup(p, translations(spark, sf_dir), target="en")


def translations(spark, sf_dir):
    """Translation table keyed by text hash (stands in for the service's
    output): the light-cleaned, upper-cased first sentence marker + text."""
    d = table(spark, sf_dir, "documents", ["text", "lang"]).where(F.col("lang") != "en")
    return d.select(F.md5("text").alias("text_key"),
                    F.concat(F.lit("[en] "), T.clean_text_light(F.col("text"))).alias("translation")).distinct()


TRANSLATED = S.POSTS + """,
translations AS (SELECT DISTINCT md5(text) AS text_key, '[en] ' || """ + S.clean_text_light("text") + """ AS translation
                 FROM documents WHERE lang <> 'en'),
tposts AS (SELECT p.*, CASE WHEN p.language = 'en' THEN p.text ELSE t.translation END AS translated_text
           FROM posts p LEFT JOIN translations t ON md5(p.text) = t.text_key)"""


# ---------------------------------------------------------------- 2.1 sources
@query("scan_posts", "SELECT doc_id AS id, source, lang AS language, text FROM documents")
def scan_posts(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "source", "lang", "text"])
    return d.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("language"), "text")


@query("posts_by_split", f"""WITH {TRANSLATED}
SELECT id, source, language, task1, task2, translated_text AS text, text AS original_text
FROM tposts WHERE split = 'train' AND language IN ('es', 'en')""")
def posts_by_split(spark, sf_dir):
    p = translated_posts(spark, sf_dir)
    p = RL.filter_language(p.where(F.col("split") == "train"), ["es", "en"])
    p = p.select("id", "source", "language", "task1", "task2", "text", "translated_text")
    return RL.swap_text_columns(p)


@query("scan_lexicon", """SELECT DISTINCT trim(t) AS term FROM
  (SELECT unnest([p_name, p_brand, p_type]) AS t FROM part) WHERE t IS NOT NULL AND trim(t) <> ''""")
def scan_lexicon(spark, sf_dir):
    """Flatten every cell of a term table (here the part table's names,
    brands and types) into one distinct term list."""
    return flatten_terms(table(spark, sf_dir, "part", ["p_name", "p_brand", "p_type"]))


@query("scan_reference_items", f"WITH {S.reference_items(GENDERED)} SELECT * FROM reference_items")
def scan_reference_items(spark, sf_dir):
    return reference_items(spark, sf_dir)


@query("scan_token_vectors", """
SELECT vec_id AS id, CAST(p AS INTEGER) AS pos, CAST(d AS INTEGER) AS dim,
       round(CAST(embedding[8 * p + d + 1] AS DOUBLE), 6) + 0.0 AS value
FROM embeddings, range(8) r(p), range(8) s(d)""")
def scan_token_vectors(spark, sf_dir):
    """Document x position x dimension: each 64-float embedding cut into 8
    positions of 8 dimensions, in long form."""
    tv = J.token_vectors_from_embeddings(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), 8)
    return tv.select("id", "pos", A.posexplode("vec").alias("dim", "value")).select(
        "id", "pos", "dim", R6(F.col("value").cast("double")).alias("value"))


# ---------------------------------------------------------------- 2.2 projections and labels
@query("prune_columns", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def prune_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return RL.prune_columns(li.where(F.col("l_returnflag") == "R"), ["l_orderkey", "l_partkey", "l_quantity"])


@query("swap_text_columns", f"""WITH {TRANSLATED}
SELECT id, translated_text AS text, text AS original_text FROM tposts""")
def swap_text_columns(spark, sf_dir):
    p = translated_posts(spark, sf_dir).select("id", "text", "translated_text")
    return RL.swap_text_columns(p)


@query("filter_language", f"WITH {S.POSTS} SELECT id, language FROM posts WHERE language IN ('es', 'en')")
def filter_language(spark, sf_dir):
    return RL.filter_language(corpus.posts(spark, sf_dir), ["es", "en"]).select("id", "language")


@query("filter_originals", f"WITH {S.reference_items(GENDERED)} SELECT id, text FROM reference_items WHERE of_id = -1")
def filter_originals(spark, sf_dir):
    return RL.filter_originals(reference_items(spark, sf_dir)).select("id", "text")


@query("filter_group", f"WITH {S.POSTS} SELECT id, source FROM posts WHERE source = 'src3'")
def filter_group(spark, sf_dir):
    return RL.filter_group(corpus.posts(spark, sf_dir), "source", "src3").select("id", "source")


@query("filter_comment_terms", f"""WITH {S.SOCIAL}
SELECT DISTINCT t AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '(^|{S.NW})([@#]{S.W}+)', 2)) AS t FROM social
  WHERE split = 'train') WHERE NOT starts_with(t, '#')""")
def filter_comment_terms(spark, sf_dir):
    """Mention and hashtag terms of the training posts, minus the terms that
    start with '#'."""
    s = corpus.social(spark, sf_dir).where(F.col("split") == "train")
    terms = s.select(A.explode(T.social_tokens(F.col("text"))).alias("term")).where(
        F.col("term").rlike("^[@#]")).distinct()
    return RL.filter_comment_terms(terms)


@query("filter_min_freq", f"""
SELECT t AS token, count(*) AS n FROM (SELECT unnest({S.word_tokens(S.clean_text('text'))}) AS t FROM documents)
GROUP BY t HAVING count(*) > 10""")
def filter_min_freq(spark, sf_dir):
    return RL.filter_min_freq(C.unigram_counts(corpus.doc_tokens(spark, sf_dir), "tokens"), 10)


@query("filter_tokens", f"""WITH {S.TOKENS}
SELECT doc_id, count(*) AS n_kept FROM tokens
WHERE NOT regexp_full_match(form, '\\p{{N}}+') AND NOT list_contains({S.lit_list(corpus.STOPWORDS)}, lemma)
GROUP BY doc_id""")
def filter_tokens(spark, sf_dir):
    tok = corpus.tokens(spark, sf_dir)
    stop = corpus.lexicon_df(spark, corpus.STOPWORDS).select("term")
    kept = RL.filter_tokens(tok, stopwords=stop)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"))


def _booster_counts(spark, sf_dir):
    return C.lexicon_counts(corpus.doc_tokens(spark, sf_dir), "tokens", corpus.BOOSTERS)


_BOOSTER_COUNTS = f"""bc AS (
  SELECT id, t AS term, count(*) AS n FROM (SELECT doc_id AS id, unnest({S.word_tokens(S.clean_text('text'))}) AS t FROM documents)
  WHERE list_contains({S.lit_list(corpus.BOOSTERS)}, t) GROUP BY id, t)"""


@query("prefix_columns", f"WITH {_BOOSTER_COUNTS} SELECT id, 'boosters_' || term AS name, CAST(n AS DOUBLE) AS value FROM bc")
def prefix_columns(spark, sf_dir):
    long = _booster_counts(spark, sf_dir).select("id", F.col("term").alias("name"), F.col("n").cast("double").alias("value"))
    return J.prefix_long(long, "boosters")


@query("select_by_prefix", """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem""")
def select_by_prefix(spark, sf_dir):
    return RL.select_by_prefix(table(spark, sf_dir, "lineitem"), ["l_ext", "l_dis", "l_tax"],
                               keep=["l_orderkey", "l_linenumber"])


_POSTS_LAB = """pl AS (SELECT d.doc_id AS id, d.lang AS language, l.quality, l.toxic,
  CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'non-toxic' END AS task1
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _posts_lab(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "lang"])
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("language"), "quality", "toxic",
        F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "non-toxic").alias("task1"))


@query("fill_missing", f"""WITH {_POSTS_LAB}
SELECT id, language, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, coalesce(task1, 'dontknow') AS task1 FROM pl""")
def fill_missing(spark, sf_dir):
    return RL.fill_missing(_posts_lab(spark, sf_dir))


@query("drop_incomplete", f"WITH {_POSTS_LAB} SELECT * FROM pl WHERE quality IS NOT NULL AND toxic IS NOT NULL AND task1 IS NOT NULL")
def drop_incomplete(spark, sf_dir):
    return RL.drop_incomplete(_posts_lab(spark, sf_dir))


@query("cast_columns", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents")
def cast_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "n_chars"]).withColumnRenamed("doc_id", "id")
    return RL.cast_columns(d, {"id": "string", "n_chars": "double"})


_CODE_CASE = "CASE task2 " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TASK2_CODE.items()) + " END"


@query("map_labels", f"WITH {S.POSTS} SELECT id, {_CODE_CASE} AS code FROM posts")
def map_labels(spark, sf_dir):
    p = corpus.posts(spark, sf_dir)
    return p.select("id", RL.map_labels(F.col("task2"), TASK2_CODE).alias("code"))


@query("label_dictionary", f"""WITH {S.POSTS}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT task2 AS label FROM posts WHERE task2 IS NOT NULL)""")
def label_dictionary(spark, sf_dir):
    return RL.label_dictionary(corpus.posts(spark, sf_dir), "task2")


_ENCODED = S.POSTS + """,
codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS code
          FROM (SELECT DISTINCT task2 AS label FROM posts WHERE split = 'train'))"""


def _encoded(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("task2").isNotNull())
    model = RL.fit_label_encoder(p.where(F.col("split") == "train"), "task2")
    return model, model.transform(p)


@query("encode_labels", f"""WITH {_ENCODED}
SELECT id, task2, code FROM posts JOIN codes ON task2 = label""")
def encode_labels(spark, sf_dir):
    _, enc = _encoded(spark, sf_dir)
    return enc.select("id", "task2", "code")


@query("decode_labels", f"""WITH {_ENCODED}
SELECT id, code, label FROM posts JOIN codes ON task2 = label""")
def decode_labels(spark, sf_dir):
    model, enc = _encoded(spark, sf_dir)
    return RL.decode_labels(enc.select("id", "code"), model)


@query("binarize_multiclass", f"""WITH {_ENCODED}
SELECT id, code, CASE WHEN code = 2 THEN 2.0 ELSE 1.0 END AS binary FROM posts JOIN codes ON task2 = label""")
def binarize_multiclass(spark, sf_dir):
    _, enc = _encoded(spark, sf_dir)
    return enc.select("id", "code", RL.binarize_multiclass(F.col("code"), 2.0, 1.0).alias("binary"))


@query("one_hot", f"""WITH {S.POSTS}
SELECT id, language, CAST(language = 'en' AS DOUBLE) AS language_en, CAST(language = 'es' AS DOUBLE) AS language_es,
       CAST(language = 'fr' AS DOUBLE) AS language_fr FROM posts""")
def one_hot(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).select("id", "language")
    return RL.one_hot(p, "language", ["de", "en", "es", "fr"], drop="first")


@query("passthrough_columns", f"WITH {S.POSTS} SELECT id, language, source FROM posts")
def passthrough_columns(spark, sf_dir):
    return RL.passthrough_columns(corpus.posts(spark, sf_dir), ["language", "source"])


@query("sample_rows", f"""WITH {S.POSTS}
SELECT id, language FROM posts ORDER BY {S.phash('id')}, id LIMIT 50""")
def sample_rows(spark, sf_dir):
    """Seeded sample of 50 posts (the sampling operator's own limit)."""
    return RL.sample_rows(corpus.posts(spark, sf_dir).select("id", "language"), 50)


# ---------------------------------------------------------------- 2.3 joins on keys
def _long_features(spark, sf_dir):
    tok = corpus.doc_tokens(spark, sf_dir)
    hedges = [t for t in corpus.HEDGES if not t.startswith("#")]
    soc = corpus.social(spark, sf_dir)
    parts = [
        C.lexicon_totals(tok, "tokens", hedges).select("id", F.lit("hedges_total").alias("name"),
                                                      F.col("total").cast("double").alias("value")),
        C.lexicon_totals(tok, "tokens", corpus.BOOSTERS).where(F.col("total") > 0).select(
            "id", F.lit("boosters_total").alias("name"), F.col("total").cast("double").alias("value")),
        soc.where(F.col("split") == "train").select("id", F.lit("hashtag_count").alias("name"),
                                                    T.count_hashtags(F.col("text")).cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FEATURES_SQL = f"""{S.SOCIAL},
tok AS (SELECT doc_id AS id, {S.word_tokens(S.clean_text('text'))} AS tokens FROM documents),
feats AS (
  SELECT id, 'hedges_total' AS name, CAST(len(list_filter(tokens, lambda t: list_contains({S.lit_list([h for h in corpus.HEDGES if not h.startswith('#')])}, t))) AS DOUBLE) AS value FROM tok
  UNION ALL
  SELECT id, 'boosters_total', CAST(len(list_filter(tokens, lambda t: list_contains({S.lit_list(corpus.BOOSTERS)}, t))) AS DOUBLE) FROM tok
    WHERE len(list_filter(tokens, lambda t: list_contains({S.lit_list(corpus.BOOSTERS)}, t))) > 0
  UNION ALL
  SELECT id, 'hashtag_count', CAST(len(regexp_extract_all(text, '{S.HASHTAG}')) AS DOUBLE) FROM social WHERE split = 'train')"""


@query("join_features", f"""WITH {_FEATURES_SQL}
SELECT p.id, p.language,
  max(CASE WHEN f.name = 'boosters_total' THEN f.value END) AS boosters_total,
  max(CASE WHEN f.name = 'hashtag_count' THEN f.value END) AS hashtag_count,
  max(CASE WHEN f.name = 'hedges_total' THEN f.value END) AS hedges_total
FROM posts p LEFT JOIN feats f ON p.id = f.id GROUP BY p.id, p.language""")
def join_features(spark, sf_dir):
    base = corpus.posts(spark, sf_dir).select("id", "language")
    return J.join_features(base, _long_features(spark, sf_dir), ["boosters_total", "hashtag_count", "hedges_total"])


def score_responses(df, text_col, keep=()):
    """Deterministic text scores in the service's JSON shape: shares of
    lexicon words among the tokens."""
    toks = T.word_tokens(F.col(text_col))
    n = F.greatest(F.size(toks), F.lit(1))
    share = lambda terms: F.size(C.lexicon_hits(toks, terms)) / n
    def score(terms):
        return F.struct(F.struct(R6(share(terms)).alias("value")).alias("summaryScore"))

    scores = F.struct(score(GENDERED).alias("GENDERED"), score(corpus.BOOSTERS).alias("BOOSTER"))
    return df.select("id", *keep, F.to_json(F.struct(scores.alias("attributeScores"))).alias("response"))


def score_sql(e):
    toks = S.word_tokens(e)
    return {name: f"round(len(list_filter({toks}, lambda t: list_contains({S.lit_list(terms)}, t))) / greatest(len({toks}), 1), 6)"
            for name, terms in [("GENDERED", GENDERED), ("BOOSTER", corpus.BOOSTERS)]}


_ORIG = score_sql("text")
_MASK = score_sql(S.mask_terms("text", GENDERED))


@query("score_difference", f"""
SELECT doc_id AS id, name, round(o - m, 6) + 0.0 AS value FROM (
  SELECT doc_id, 'GENDERED' AS name, {_ORIG['GENDERED']} AS o, {_MASK['GENDERED']} AS m FROM documents
  UNION ALL
  SELECT doc_id, 'BOOSTER', {_ORIG['BOOSTER']}, {_MASK['BOOSTER']} FROM documents)""")
def score_difference(spark, sf_dir):
    """Scores of the original text minus scores of the masked text, per
    score name (long form, joined on (id, name))."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    orig = J.parse_scores(score_responses(d, "text"), "response")
    masked = J.parse_scores(score_responses(d.withColumn("text", T.mask_terms(F.col("text"), GENDERED)), "text"), "response")
    return J.score_difference(orig, masked).select("id", "name", R6(F.col("value")).alias("value"))


@query("restrict_to_keys", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def restrict_to_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id"]).withColumnRenamed("doc_id", "id")
    keys = table(spark, sf_dir, "labels", ["doc_id"]).withColumnRenamed("doc_id", "id")
    return J.restrict_to_keys(d, keys, "id")


@query("missing_keys", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id"]).withColumnRenamed("doc_id", "id")
    keys = table(spark, sf_dir, "labels", ["doc_id"]).withColumnRenamed("doc_id", "id")
    return J.missing_keys(d, keys, "id")


_VOCAB = f"""toks AS (SELECT doc_id AS id, unnest({S.word_tokens(S.clean_text('text'))}) AS token FROM documents),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS tok_id FROM (SELECT token FROM toks GROUP BY token HAVING count(*) > 10))"""


@query("token_ids", f"""WITH {_VOCAB}
SELECT id, count(*) AS n_in_vocab, CAST(sum(tok_id) AS BIGINT) AS sum_ids FROM toks JOIN vocab USING (token) GROUP BY id""")
def token_ids(spark, sf_dir):
    """Tokens -> ids of the frequency-pruned vocabulary; out-of-vocabulary
    tokens dropped (inner join)."""
    tok = corpus.doc_tokens(spark, sf_dir)
    vocab = J.build_vocabulary(tok, "tokens", min_count=10)
    ids = J.token_ids(A.explode_counts(tok, "id", "tokens"), vocab)
    return ids.groupBy("id").agg(F.sum("n").cast("long").alias("n_in_vocab"), F.sum(F.col("n") * F.col("tok_id")).cast("long").alias("sum_ids"))


@query("token_weights", f"""WITH {S.POSTS},
toks AS (SELECT p.id, p.split, unnest({S.word_tokens(S.clean_text('p.text'))}) AS token FROM posts p),
tr AS (SELECT token, count(*) AS n FROM toks WHERE split = 'train' GROUP BY token),
wt AS (SELECT token, 0.001 / (0.001 + n / (SELECT sum(n) FROM tr)) AS w FROM tr)
SELECT id, count(*) AS n_tokens, round(sum(coalesce(w, 0.000001)), 6) + 0.0 AS weight_sum
FROM toks LEFT JOIN wt USING (token) GROUP BY id""")
def token_weights(spark, sf_dir):
    """Weight per token from the training split's frequencies
    (a / (a + count / total)); tokens without a weight get 1e-6."""
    tok = A.explode_counts(corpus.doc_tokens(spark, sf_dir), "id", "tokens")
    train = J.restrict_to_keys(tok, table(spark, sf_dir, "labels", ["doc_id"]).withColumnRenamed("doc_id", "id"))
    w = J.token_weights(tok, J.sif_weights(train, "token", a=1e-3, n="n"))
    return w.groupBy("id").agg(F.sum("n").cast("long").alias("n_tokens"), R6(F.sum(F.col("n") * F.col("w"))).alias("weight_sum"))


@query("translate_lookup", f"WITH {TRANSLATED} SELECT id, language, translated_text FROM tposts")
def translate_lookup(spark, sf_dir):
    return translated_posts(spark, sf_dir).select("id", "language", "translated_text")


# ---------------------------------------------------------------- 2.4 counts
@query("group_share", f"""WITH {S.POSTS}
SELECT language, task2, count(*) AS n, round(count(*) / (SELECT count(*) FROM posts), 6) + 0.0 AS share
FROM posts GROUP BY language, task2""")
def group_share(spark, sf_dir):
    g = C.group_share(corpus.posts(spark, sf_dir), ["language", "task2"])
    return g.withColumn("share", R6(F.col("share")))


@query("group_pivot", f"""WITH {S.POSTS}
SELECT language, count(*) FILTER (WHERE task2 = 'high-clean') AS "high-clean",
  count(*) FILTER (WHERE task2 = 'high-toxic') AS "high-toxic", count(*) FILTER (WHERE task2 = 'low-clean') AS "low-clean",
  count(*) FILTER (WHERE task2 = 'low-toxic') AS "low-toxic" FROM posts GROUP BY language""")
def group_pivot(spark, sf_dir):
    return C.group_pivot(corpus.posts(spark, sf_dir), "language", "task2", sorted(corpus.TASK2_NAMES))


@query("group_sizes", f"WITH {S.POSTS} SELECT task2, count(*) AS n FROM posts GROUP BY task2")
def group_sizes(spark, sf_dir):
    return C.group_sizes(corpus.posts(spark, sf_dir), ["task2"])


@query("value_counts", f"""WITH {S.SOCIAL}
SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '#{S.W}+')) AS tag FROM social WHERE split = 'train') GROUP BY tag""")
def value_counts(spark, sf_dir):
    s = corpus.social(spark, sf_dir).where(F.col("split") == "train")
    return C.value_counts(s.select(A.explode(T.extract_hashtags(F.col("text"))).alias("tag")), "tag")


@query("distinct_values", f"WITH {S.POSTS} SELECT DISTINCT task2 FROM posts")
def distinct_values(spark, sf_dir):
    return C.distinct_values(corpus.posts(spark, sf_dir), "task2")


@query("lexicon_counts", f"WITH {_BOOSTER_COUNTS} SELECT id, term, n FROM bc")
def lexicon_counts(spark, sf_dir):
    return _booster_counts(spark, sf_dir)


@query("lexicon_totals", f"""SELECT doc_id AS id,
  CAST(len(list_filter({S.word_tokens(S.clean_text('text'))}, lambda t: list_contains({S.lit_list([h for h in corpus.HEDGES if not h.startswith('#')])}, t))) AS BIGINT) AS total
FROM documents""")
def lexicon_totals(spark, sf_dir):
    hedges = [t for t in corpus.HEDGES if not t.startswith("#")]
    return C.lexicon_totals(corpus.doc_tokens(spark, sf_dir), "tokens", hedges)


def _social_vocab_counts(spark, sf_dir, prefix):
    """(ids, counts): the tags are taken out of each text first, so that only
    they are joined with the labels, grouped and moved."""
    extract = T.extract_hashtags if prefix == "#" else T.extract_mentions
    tags = F.filter(T.social_tokens(F.col("text")), lambda t: F.startswith(t, F.lit(prefix)))
    s = cut_lineage(corpus.social_text(spark, sf_dir).select("id", tags.alias("tokens"), extract(F.col("text")).alias("found")))
    train = table(spark, sf_dir, "labels", ["doc_id", "toxic"]).where("toxic is not null").select(F.col("doc_id").alias("id"))
    vocab = s.join(train, "id", "left_semi").select(A.explode("found").alias("term")).select(F.lower("term").alias("term")).distinct()
    return s.select("id", "tokens"), C.vocabulary_counts(s, "tokens", vocab)


def _social_vocab_sql(prefix):
    return f"""{S.SOCIAL},
vocab AS (SELECT DISTINCT lower(t) AS term FROM (SELECT unnest(regexp_extract_all(text, '\\{prefix}{S.W}+')) AS t FROM social WHERE split = 'train')),
st AS (SELECT id, unnest(regexp_extract_all(lower(text), '(^|{S.NW})([@#]{S.W}+)', 2)) AS term FROM social),
vc AS (SELECT id, term, count(*) AS n FROM st WHERE term IN (SELECT term FROM vocab) GROUP BY id, term)"""


@query("hashtag_counts", f"WITH {_social_vocab_sql('#')} SELECT id, term, n FROM vc")
def hashtag_counts(spark, sf_dir):
    """Count of every training-set hashtag in every document (vocabulary and
    tokens both lower-cased)."""
    return _social_vocab_counts(spark, sf_dir, "#")[1]


@query("mention_matrix", f"WITH {_social_vocab_sql('@')} SELECT id, term, n FROM vc")
def mention_matrix(spark, sf_dir):
    return _social_vocab_counts(spark, sf_dir, "@")[1]


@query("hashtag_total", f"""WITH {_social_vocab_sql('#')}
SELECT s.id, CAST(coalesce(sum(vc.n), 0) AS BIGINT) AS total FROM social s LEFT JOIN vc ON s.id = vc.id GROUP BY s.id""")
def hashtag_total(spark, sf_dir):
    tok, vc = _social_vocab_counts(spark, sf_dir, "#")
    return J.row_totals(tok.select("id"), vc)


@query("mention_total", f"""WITH {_social_vocab_sql('@')}
SELECT s.id, CAST(coalesce(sum(vc.n), 0) AS BIGINT) AS total FROM social s LEFT JOIN vc ON s.id = vc.id GROUP BY s.id""")
def mention_total(spark, sf_dir):
    tok, vc = _social_vocab_counts(spark, sf_dir, "@")
    return J.row_totals(tok.select("id"), vc)


@query("unigram_counts", f"""SELECT t AS token, count(*) AS n FROM (SELECT unnest({S.word_tokens(S.clean_text('text'))}) AS t FROM documents) GROUP BY t""")
def unigram_counts(spark, sf_dir):
    return C.unigram_counts(corpus.doc_tokens(spark, sf_dir), "tokens")


@query("max_len", f"SELECT CAST(least(max(len({S.word_tokens(S.clean_text('text'))})), 100) AS BIGINT) AS max_len FROM documents")
def max_len(spark, sf_dir):
    return C.max_len(corpus.doc_tokens(spark, sf_dir), "tokens", 100)


# ---------------------------------------------------------------- 2.5 windows
_STRATA = S.POSTS + f""",
lab AS (SELECT id, language || '_' || task2 AS stratum, {S.phash('id')} AS h FROM posts WHERE task2 IS NOT NULL)"""


@query("stratified_split", f"""WITH {_STRATA}
SELECT id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY h, id)
   <= round(0.2 * count(*) OVER (PARTITION BY stratum)) THEN 'test' ELSE 'train' END AS split FROM lab""")
def stratified_split(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("task2").isNotNull())
    lab = p.select("id", T.compose_key(F.col("language"), F.col("task2")).alias("stratum"))
    return WN.stratified_split(lab, "stratum", 0.2).select("id", "stratum", "split")


@query("stratified_folds", f"""WITH {S.POSTS}
SELECT id, task2, CAST((row_number() OVER (PARTITION BY task2 ORDER BY {S.phash('id')}, id) - 1) % 3 AS INTEGER) AS fold
FROM posts WHERE task2 IS NOT NULL""")
def stratified_folds(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("task2").isNotNull()).select("id", "task2")
    return WN.stratified_folds(p, "task2", 3)


@query("downsample_class", f"""WITH {S.POSTS}
SELECT id, task2 FROM posts WHERE task2 IS NOT NULL AND (task2 <> 'high-clean'
  OR id IN (SELECT id FROM posts WHERE task2 = 'high-clean' ORDER BY {S.phash('id')}, id LIMIT 100))""")
def downsample_class(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("task2").isNotNull()).select("id", "task2")
    return WN.downsample_class(p, "task2", "high-clean", cap=100)


@query("truncate_tokens", f"""WITH {_VOCAB},
dt AS (SELECT doc_id AS id, {S.word_tokens(S.clean_text('text'))} AS tokens FROM documents),
e AS (SELECT id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM dt),
k AS (SELECT id, token, pos FROM e JOIN vocab USING (token) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 100)
SELECT dt.id, count(k.token) AS n_kept, coalesce(string_agg(k.token, ' ' ORDER BY k.pos), '') AS kept
FROM dt LEFT JOIN k ON dt.id = k.id GROUP BY dt.id""")
def truncate_tokens(spark, sf_dir):
    """First 100 in-vocabulary tokens per document; the vocabulary array is
    the frequency-pruned vocabulary (joined as a per-token flag, so its
    size is never shipped whole)."""
    tok = corpus.doc_tokens(spark, sf_dir)
    vocab = J.build_vocabulary(tok, "tokens", min_count=10)
    kept = J.filter_in_vocab(tok, "tokens", vocab, max_len=100)
    return kept.select("id", F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", " ").alias("kept"))


@query("context_frame", f"""WITH dt AS (SELECT doc_id, {S.word_tokens('text')} AS tokens FROM documents),
e AS (SELECT doc_id, tokens, unnest(range(len(tokens))) AS pos FROM dt)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(list_slice(tokens, greatest(pos - 1, 1), pos + 3), ' ') AS context FROM e""")
def context_frame(spark, sf_dir):
    """Tokens within +-2 positions of each token (whole documents)."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    dt = d.select("doc_id", T.word_tokens(F.col("text")).alias("tokens"))
    return J.context_frame(dt, "tokens", 2).select("doc_id", "pos", F.array_join("context", " ").alias("context"))


# ---------------------------------------------------------------- 2.6 top-k
def _top_by_class(spark, sf_dir, extract):
    s = corpus.social(spark, sf_dir).where(F.col("split") == "train")
    tags = s.select("task2", A.explode(extract(F.col("text"))).alias("value"))
    counts = tags.groupBy("task2", "value").agg(F.count("*").alias("n"))
    return WN.top_k_per_group(counts, ["task2"], [F.desc("n"), F.col("value")], 10).select("task2", "value", "n", "rank")


def _top_sql(prefix):
    return f"""WITH {S.SOCIAL},
c AS (SELECT task2, value, count(*) AS n FROM (SELECT task2, unnest(regexp_extract_all(text, '\\{prefix}{S.W}+')) AS value
      FROM social WHERE split = 'train') GROUP BY task2, value)
SELECT task2, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task2 ORDER BY n DESC, value) AS rank FROM c)
WHERE rank <= 10"""


@query("top_hashtags_by_class", _top_sql("#"))
def top_hashtags_by_class(spark, sf_dir):
    return _top_by_class(spark, sf_dir, T.extract_hashtags)


@query("top_mentions_by_class", _top_sql("@"))
def top_mentions_by_class(spark, sf_dir):
    return _top_by_class(spark, sf_dir, T.extract_mentions)


# ---------------------------------------------------------------- 2.7 set operations
@query("union_splits", f"WITH {S.POSTS} SELECT id, split FROM posts WHERE split = 'train' UNION ALL SELECT id, split FROM posts WHERE split = 'test'")
def union_splits(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).select("id", "split")
    return SO.union_splits(p.where(F.col("split") == "train"), p.where(F.col("split") == "test"))


@query("union_languages", f"WITH {S.POSTS} SELECT id, language FROM posts WHERE language = 'en' UNION ALL SELECT id, language FROM posts WHERE language = 'es'")
def union_languages(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).select("id", "language")
    return SO.union_splits(p.where(F.col("language") == "en"), p.where(F.col("language") == "es"))


@query("vocabulary_diff", f"""WITH {S.POSTS},
w AS (SELECT DISTINCT split, unnest({S.word_tokens(S.clean_text('text'))}) AS token FROM posts),
a AS (SELECT token FROM w WHERE split = 'train' EXCEPT SELECT token FROM w WHERE split = 'test'),
b AS (SELECT token FROM w WHERE split = 'test' EXCEPT SELECT token FROM w WHERE split = 'train')
SELECT 'train_only' AS side, token, (SELECT count(*) FROM a) AS size FROM a
UNION ALL SELECT 'test_only', token, (SELECT count(*) FROM b) FROM b""")
def vocabulary_diff(spark, sf_dir):
    """Words of the training posts only and of the test posts only."""
    tok = corpus.doc_tokens(spark, sf_dir)
    keys = table(spark, sf_dir, "labels", ["doc_id"]).withColumnRenamed("doc_id", "id")
    train, test = (part.select(A.explode("tokens").alias("token")) for part in (J.restrict_to_keys(tok, keys), J.missing_keys(tok, keys)))
    return SO.vocabulary_diff(train, test, "token")


@query("dedupe_terms", f"""WITH {S.SOCIAL}
SELECT DISTINCT lower(t) AS term FROM (SELECT unnest(regexp_extract_all(text, '#{S.W}+')) AS t FROM social)""")
def dedupe_terms(spark, sf_dir):
    s = corpus.social(spark, sf_dir)
    tags = s.select(A.explode(T.extract_hashtags(F.col("text"))).alias("tag"))
    return SO.dedupe_terms(tags.select(F.lower("tag").alias("term")), "term")


@query("feature_subsets", """WITH f AS (SELECT source AS name, row_number() OVER (ORDER BY source) - 1 AS bit FROM (SELECT DISTINCT source FROM documents)),
m AS (SELECT range AS mask FROM range(CAST(pow(2, (SELECT count(*) FROM f)) AS BIGINT)))
SELECT mask, CAST(bit_count(mask) AS INTEGER) AS size,
  (SELECT string_agg(name, ',' ORDER BY bit) FROM f WHERE (mask >> bit) & 1 = 1) AS members
FROM m WHERE bit_count(mask) >= (SELECT count(*) FROM f) - 2""")
def feature_subsets(spark, sf_dir):
    """All subsets with at least n - 2 members of the feature list (here
    the distinct document sources), largest first by construction."""
    names = table(spark, sf_dir, "documents", ["source"]).select(F.col("source").alias("name")).distinct()
    return SO.feature_subsets(names, "name", min_size_from_top=2)
