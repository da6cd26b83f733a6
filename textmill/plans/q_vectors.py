"""Queries for skip-grams, PPMI and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import arrays as A

from textmill.operators import vectors as V
from textmill.operators.joins import sif_weights
from textmill.plans import corpus
from textmill.plans.registry import query
from textmill.plans import sqlparts as S
from textmill.session import cut_lineage
from textmill.sources.files import table


def R6(c):
    return F.round(c, 6) + F.lit(0.0)


WINDOW = 3
MIN_COUNT = 10
# Dimensions of the explicit PPMI vectors used where an exact oracle is wanted:
# the columns of the corpus's most frequent words (as wide as the SVD's vectors).
DIMS = 50


def _doc_tokens(spark, sf_dir):
    return corpus.doc_tokens(spark, sf_dir).withColumnRenamed("id", "doc_id")


def _arrays(spark, sf_dir):
    return V.in_vocab_arrays(_doc_tokens(spark, sf_dir), "tokens", MIN_COUNT)


def _counts(spark, sf_dir, docs=None):
    """Of all documents, or of ``docs``, which are written already."""
    vocab, arrays = _arrays(spark, sf_dir) if docs is None else V.in_vocab_arrays(docs, "tokens", MIN_COUNT, written=True)
    return vocab, V.skipgram_counts(V.skipgram_pairs(arrays, WINDOW, rows=False), vocab)


SKIP_SQL = f"""toks AS (SELECT doc_id, unnest(tl) AS token, unnest(range(len(tl))) AS pos
              FROM (SELECT doc_id, {S.word_tokens(S.clean_text('text'))} AS tl FROM documents)),
vocab AS (SELECT token, count(*) AS n FROM toks GROUP BY token HAVING count(*) > {MIN_COUNT}),
kept AS (SELECT doc_id, list(token ORDER BY pos) AS arr FROM toks JOIN vocab USING (token) GROUP BY doc_id),
e AS (SELECT doc_id, arr, unnest(range(len(arr))) AS p FROM kept WHERE len(arr) > 1),
w AS (SELECT doc_id, arr, p, 1 + ('0x' || substr(md5(doc_id || ':' || p || ':42'), 1, 8))::BIGINT % {WINDOW} AS w FROM e),
qq AS (SELECT doc_id, arr, p, unnest(range(greatest(0, p - w), least(len(arr) - 1, p + w) + 1)) AS q FROM w),
pairs AS (SELECT doc_id, p, q, arr[p + 1] AS word, arr[q + 1] AS context FROM qq WHERE q <> p),
sc AS (SELECT word, context, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY word, context)"""

PPMI_SQL = SKIP_SQL + """,
rw AS (SELECT word, sum(n) AS n_w FROM sc GROUP BY word),
cl AS (SELECT context, sum(n) AS n_c FROM sc GROUP BY context),
tot AS (SELECT sum(n) AS d FROM sc),
atot AS (SELECT sum(pow(n_c, 0.75)) AS a FROM cl),
pm AS (SELECT sc.word, sc.context,
   greatest(log2((sc.n / tot.d) / ((rw.n_w / tot.d) * (pow(cl.n_c, 0.75) / atot.a))), 0.0) AS ppmi
   FROM sc JOIN rw USING (word) JOIN cl USING (context), tot, atot)"""


@query("skipgram_pairs", f"""WITH {SKIP_SQL}
SELECT doc_id, CAST(q - p AS INTEGER) AS d, count(*) AS n FROM pairs GROUP BY doc_id, q - p""")
def skipgram_pairs(spark, sf_dir):
    """Pairs per document and signed distance (window 1..3 drawn per word by
    a seeded hash)."""
    _, arrays = _arrays(spark, sf_dir)
    pairs = V.skipgram_pairs(arrays, WINDOW)
    return pairs.groupBy("doc_id", (F.col("q") - F.col("p")).cast("int").alias("d")).agg(F.count("*").alias("n"))


@query("skipgram_counts", f"WITH {SKIP_SQL} SELECT word, context, n FROM sc")
def skipgram_counts(spark, sf_dir):
    return _counts(spark, sf_dir)[1]


@query("count_matrix", f"""WITH {SKIP_SQL}
SELECT word, context, CAST(sum(n) AS BIGINT) AS n,
  CASE grouping(word, context) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'col' ELSE 'all' END AS kind
FROM sc GROUP BY GROUPING SETS ((word, context), (word), (context), ())""")
def count_matrix(spark, sf_dir):
    """Cells, row totals, column totals and the grand total.  The totals are
    summed from the written cells, so no cell is shuffled once for each kind."""
    cells = cut_lineage(_counts(spark, sf_dir)[1].select("word", "context", F.col("n").cast("long").alias("n")))
    none, total = F.lit(None).cast("string"), F.sum("n").cast("long").alias("n")
    rows = cells.groupBy("word").agg(total).select("word", none.alias("context"), "n", F.lit("row").alias("kind"))
    cols = cells.groupBy("context").agg(total).select(none.alias("word"), "context", "n", F.lit("col").alias("kind"))
    grand = cells.agg(total).select(none.alias("word"), none.alias("context"), "n", F.lit("all").alias("kind"))
    return cells.withColumn("kind", F.lit("cell")).unionByName(rows).unionByName(cols).unionByName(grand)


@query("ppmi_marginals", f"""WITH {PPMI_SQL}
SELECT word, context, n, n_w, n_c FROM sc JOIN rw USING (word) JOIN cl USING (context)""")
def ppmi_marginals(spark, sf_dir):
    return V.ppmi_marginals(cut_lineage(_counts(spark, sf_dir)[1]))


@query("ppmi", f"WITH {PPMI_SQL} SELECT word, context, round(ppmi, 6) + 0.0 AS ppmi FROM pm")
def ppmi(spark, sf_dir):
    m = V.ppmi(_counts(spark, sf_dir)[1], 0.75)
    return m.select("word", "context", R6(F.col("ppmi")).alias("ppmi"))


@query("most_similar_words", f"""WITH {PPMI_SQL},
t AS (SELECT context, ppmi AS tv FROM pm WHERE word = 'the'),
dots AS (SELECT word, sum(ppmi * tv) AS dot FROM pm JOIN t USING (context) GROUP BY word),
norms AS (SELECT word, sqrt(sum(ppmi * ppmi)) AS nrm FROM pm GROUP BY word)
SELECT word, round(dot / (nrm * (SELECT sqrt(sum(tv * tv)) FROM t)), 6) + 0.0 AS cos
FROM dots JOIN norms USING (word) ORDER BY dot / (nrm * (SELECT sqrt(sum(tv * tv)) FROM t)) DESC, word LIMIT 10""")
def most_similar_words(spark, sf_dir):
    """Top 10 words by cosine of PPMI rows to 'the' (itself included)."""
    m = V.ppmi(_counts(spark, sf_dir)[1], 0.75)
    sims = V.most_similar(m, "the", 10)
    return sims.select("word", R6(F.col("cos")).alias("cos"))


@query("sif_weight", f"""WITH u AS (SELECT t AS token, count(*) AS n FROM
  (SELECT unnest({S.word_tokens(S.clean_text('text'))}) AS t FROM documents) GROUP BY t)
SELECT token, round(0.001 / (0.001 + n / (SELECT sum(n) FROM u)), 6) + 0.0 AS weight FROM u""")
def sif_weight(spark, sf_dir):
    tok = corpus.doc_tokens(spark, sf_dir).select(A.explode("tokens").alias("token"))
    return sif_weights(tok, "token", 1e-3).select("token", R6(F.col("w")).alias("weight"))


@query("cosine", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS cos
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.join(b, "vec_id")
    return j.select("vec_id", R6(V.cosine(F.col("embedding").cast("array<double>"),
                                          F.col("other").cast("array<double>"))).alias("cos"))


_TV_SQL = """tv AS (SELECT vec_id AS id, p AS pos, d AS dim, CAST(embedding[8 * p + d + 1] AS DOUBLE) AS x
            FROM embeddings, range(8) r(p), range(8) s(d))"""


@query("pool_vectors", f"""WITH {_TV_SQL}
SELECT id, 'first' AS mode, CAST(dim AS INTEGER) AS dim, round(x, 6) + 0.0 AS value FROM tv WHERE pos = 0
UNION ALL SELECT id, 'mean', CAST(dim AS INTEGER), round(avg(x), 6) + 0.0 FROM tv GROUP BY id, dim
UNION ALL SELECT id, 'mean_rest', CAST(dim AS INTEGER), round(avg(x), 6) + 0.0 FROM tv WHERE pos >= 1 GROUP BY id, dim""")
def pool_vectors(spark, sf_dir):
    """First position, mean of all, mean of all but the first."""
    from textmill.operators.joins import token_vectors_from_embeddings
    tv = token_vectors_from_embeddings(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), 8)
    outs = []
    for mode in ["first", "mean", "mean_rest"]:
        pv = V.pool_vectors(tv, mode)
        outs.append(pv.select("id", F.lit(mode).alias("mode"), A.posexplode("vec").alias("dim", "value"))
                    .select("id", "mode", "dim", R6(F.col("value")).alias("value")))
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


def explicit_vectors(spark, sf_dir, docs=None):
    """(token, vec): PPMI row of every vocabulary word restricted to the
    ``DIMS`` most frequent words as contexts (0 where absent)."""
    vocab, counts = _counts(spark, sf_dir, docs)
    contexts = [r["token"] for r in vocab.orderBy(F.col("n").desc(), "token").limit(DIMS).collect()]
    m = V.ppmi(counts, 0.75, contexts)
    maps = m.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("context", "ppmi"))).alias("m"))
    v = vocab.select("token").join(maps.withColumnRenamed("word", "token"), "token", "left")
    # read several times downstream (weights, distances): written once
    return cut_lineage(v.select("token", F.array(*[F.coalesce(F.col("m")[c], F.lit(0.0)) for c in contexts])
                                .cast("array<double>").alias("vec")))


EXPLICIT_SQL = PPMI_SQL + f""",
ctx AS (SELECT token AS ctx, row_number() OVER (ORDER BY n DESC, token) - 1 AS dim FROM vocab QUALIFY dim < {DIMS}),
vec AS (SELECT v.token, ctx.dim, coalesce(pm.ppmi, 0.0) AS x FROM vocab v CROSS JOIN ctx
        LEFT JOIN pm ON pm.word = v.token AND pm.context = ctx.ctx)"""


@query("weighted_mean_vector", f"""WITH {EXPLICIT_SQL},
u AS (SELECT token, count(*) AS n FROM toks GROUP BY token),
wt AS (SELECT token, 0.001 / (0.001 + n / (SELECT sum(n) FROM u)) AS w FROM u),
known AS (SELECT doc_id, token FROM toks JOIN vocab USING (token))
SELECT doc_id AS id, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / count(*), 6) + 0.0 AS value
FROM known JOIN vec USING (token) JOIN wt USING (token) GROUP BY doc_id, dim
UNION ALL
SELECT d.doc_id AS id, CAST(ctx.dim AS INTEGER) AS dim, 0.0 AS value FROM documents d CROSS JOIN ctx
WHERE d.doc_id NOT IN (SELECT doc_id FROM known)""")
def weighted_mean_vector(spark, sf_dir):
    """SIF-weighted mean of word vectors over each document's in-vocabulary
    tokens (explicit PPMI vectors here, so SQL can check it)."""
    dt = cut_lineage(corpus.doc_tokens(spark, sf_dir))
    vecs = explicit_vectors(spark, sf_dir, dt.withColumnRenamed("id", "doc_id"))
    w = sif_weights(dt.select(A.explode("tokens").alias("token")), "token", 1e-3)
    out = V.weighted_vectors(dt, vecs, w, key="id")
    return out.select("id", A.posexplode("vec").alias("dim", "value")).select(
        "id", "dim", R6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- R: SVD jobs
@query("word_vectors")
def word_vectors(spark, sf_dir):
    """Tokens with count > 10, skip-grams (window 3), PPMI, truncated SVD
    (50 dimensions), U x S^0.5."""
    _, vecs, _ = V.word_vectors(_doc_tokens(spark, sf_dir), "tokens", MIN_COUNT, WINDOW, 50)
    return vecs.select("token", "tok_id", F.size("vec").alias("dims"),
                       F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


@query("document_vectors")
def document_vectors(spark, sf_dir):
    """SIF document vectors: weighted mean of the SVD word vectors of the whole
    text minus the first principal component."""
    dt = cut_lineage(corpus.doc_tokens(spark, sf_dir))
    _, vecs, _ = V.word_vectors(dt.withColumnRenamed("id", "doc_id"), "tokens", MIN_COUNT, WINDOW, 50, written=True)
    vecs = cut_lineage(vecs)
    w = sif_weights(dt.select(A.explode("tokens").alias("token")), "token", 1e-3)
    return V.document_vectors(dt, vecs, w, rmpc=1, key="id")


@query("document_vectors_fit_on")
def document_vectors_fit_on(spark, sf_dir):
    """Document vectors whose words, weights and removed component come from the
    labelled documents alone; other words are placed by their pairs with known ones."""
    labelled = table(spark, sf_dir, "labels", ["doc_id"]).select(F.col("doc_id").alias("id")).distinct()
    dt = corpus.doc_tokens(spark, sf_dir).join(labelled.withColumn("train", F.lit(True)), "id", "left")
    dt = cut_lineage(dt.select("id", "tokens", F.coalesce("train", F.lit(False)).alias("train")))
    vecs = cut_lineage(V.word_vectors_fit_on(dt, F.col("train"), "tokens", MIN_COUNT, WINDOW, 50, key="id"))
    w = sif_weights(dt.where("train").select(A.explode("tokens").alias("token")), "token", 1e-3)
    w = vecs.select("token").join(w, "token", "left").select("token", F.coalesce("w", F.lit(1.0)).alias("w"))  # never seen: a / (a + 0)
    return V.document_vectors(dt, vecs, w, rmpc=1, key="id", fit_on=labelled)


@query("remove_component")
def remove_component(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return V.remove_component(e, "vec", 1, "id")
