"""Queries for valence, nearest reference, metrics, selection, models and
sinks (SURVEY 2.1, 2.3-2.5, 2.8, 2.9)."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from textmill.functions import arrays as A

from textmill.functions import text as T
from textmill.operators import clusters as CL
from textmill.operators import joins as J
from textmill.operators import metrics as M
from textmill.operators import models as MD
from textmill.operators import nearest as NR
from textmill.operators import selection as SL
from textmill.operators import setops as SO
from textmill.operators import valence as VL
from textmill.operators import windows as WN
from textmill.operators.counts import char_ngram_counts, lexicon_counts
from textmill.plans import corpus, q_relational  # noqa: F401 (its oracles are used again below)
from textmill.plans import sqlparts as S
from textmill.plans.q_vectors import EXPLICIT_SQL, explicit_vectors
from textmill.plans.q_relational import score_responses, score_sql
from textmill.plans.registry import ORACLES, query
from textmill.session import cut_lineage, ensure_checkpoint_dir
from textmill.sources import sinks as SK
from textmill.sources.files import scan_features, spread, table


def R6(c):
    return F.round(c, 6) + F.lit(0.0)


# ---------------------------------------------------------------- valence
def _valence_sql() -> str:
    def case(expr, pairs):
        return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN CAST({float(v)} AS DOUBLE)" for k, v in pairs) + " ELSE CAST(0.0 AS DOUBLE) END"

    def step(k):
        """The k-th token before acts on the scores."""
        factor = f"CASE WHEN list_contains({S.lit_list(corpus.NEGATIONS)}, tl[i - {k}]) THEN {VL.NEGATION_SCALAR} ELSE 1.0 END"
        if k in VL.NEVER_FACTORS:
            so = " OR ".join(f"list_contains({S.lit_list(VL.NEVER_SO)}, tl[i - {j}])" for j in range(1, k))
            factor = f"CASE WHEN tl[i - {k}] = '{VL.NEVER}' AND ({so}) THEN {VL.NEVER_FACTORS[k]} ELSE {factor} END"
        boost = f"CASE WHEN bo[i - {k}] <> 0 THEN (bo[i - {k}] + CASE WHEN mixed AND cp[i - {k}] THEN {VL.CAPITALS} ELSE 0.0 END) * {VL.BOOSTER_DAMPING[k - 1]} ELSE 0.0 END"
        return (f"s{k} AS (SELECT * REPLACE (list_transform(s, lambda x, i: CASE WHEN v[i] <> 0 AND i > {k} AND v[i - {k}] = 0"
                f" THEN (x + sign(x) * ({boost})) * CAST(({factor}) AS DOUBLE) ELSE x END) AS s) FROM s{k - 1})")

    marks = lambda c: f"(length(txt) - length(replace(txt, '{c}', '')))"
    return f"""WITH d AS (SELECT doc_id AS id, {S.clean_text('text')} AS txt FROM documents),
w AS (SELECT id, txt, regexp_extract_all(txt, '{S.W}{{2,}}') AS tc FROM d),
l AS (SELECT id, txt, list_transform(tc, lambda t: lower(t)) AS tl, list_transform(tc, lambda t: t = upper(t) AND t <> lower(t)) AS cp FROM w),
b AS (SELECT *, list_contains(cp, true) AND list_contains(cp, false) AS mixed, list_transform(tl, lambda t: {case("t", corpus.VALENCE)}) AS v,
             list_transform(tl, lambda t: {case("t", corpus.VALENCE_BOOSTERS)}) AS bo,
             list_min(list_transform(tl, lambda t, i: CASE WHEN list_contains({S.lit_list(corpus.CONTRASTS)}, t) THEN i END)) AS p FROM l),
s0 AS (SELECT *, list_transform(v, lambda x, i: x + CASE WHEN mixed AND cp[i] THEN sign(x) * {VL.CAPITALS} ELSE 0.0 END) AS s FROM b),
{step(1)},
{step(2)},
{step(3)},
sc AS (SELECT id, txt, list_transform(s, lambda x, i: x
         * CASE WHEN i > 1 AND tl[i - 1] = '{VL.LEAST}' AND v[i - 1] = 0 AND NOT coalesce(i > 2 AND list_contains({S.lit_list(VL.NOT_LEAST)}, tl[i - 2]), false)
                THEN {VL.NEGATION_SCALAR} ELSE 1.0 END
         * CASE WHEN i < p THEN {VL.CONTRAST_BEFORE} WHEN i > p THEN {VL.CONTRAST_AFTER} ELSE 1.0 END) AS s FROM s3),
ag AS (SELECT id, coalesce(list_sum(s), 0.0) AS tot0,
              coalesce(list_sum(list_filter(s, lambda x: x > 0)), 0.0) + len(list_filter(s, lambda x: x > 0)) AS ps0,
              coalesce(list_sum(list_filter(s, lambda x: x < 0)), 0.0) - len(list_filter(s, lambda x: x < 0)) AS ns0,
              CAST(len(list_filter(s, lambda x: x = 0)) AS DOUBLE) AS nu,
              least({marks('!')}, {VL.MOST_EXCLAMATIONS}) * CAST({VL.EXCLAMATION} AS DOUBLE)
              + CASE WHEN {marks('?')} > {VL.MOST_QUESTIONS} THEN CAST({VL.MANY_QUESTIONS} AS DOUBLE)
                     WHEN {marks('?')} > 1 THEN {marks('?')} * CAST({VL.QUESTION} AS DOUBLE) ELSE 0.0 END AS amp FROM sc),
am AS (SELECT id, nu, tot0 + sign(tot0) * amp AS tot, ps0 + CASE WHEN ps0 > -ns0 THEN amp ELSE 0.0 END AS ps,
              ns0 - CASE WHEN ps0 < -ns0 THEN amp ELSE 0.0 END AS ns FROM ag)
SELECT id,
  round(CASE WHEN ps + abs(ns) + nu > 0 THEN abs(ns / (ps + abs(ns) + nu)) ELSE 0.0 END, 4) + 0.0 AS neg,
  round(CASE WHEN ps + abs(ns) + nu > 0 THEN abs(nu / (ps + abs(ns) + nu)) ELSE 0.0 END, 4) + 0.0 AS neu,
  round(CASE WHEN ps + abs(ns) + nu > 0 THEN abs(ps / (ps + abs(ns) + nu)) ELSE 0.0 END, 4) + 0.0 AS pos,
  round(tot / sqrt(tot * tot + {VL.NORMALISATION_ALPHA}), 4) + 0.0 AS compound
FROM am"""


@query("valence_scores", _valence_sql())
def valence_scores(spark, sf_dir):
    """neg / neu / pos shares and compound score per document, from its cleaned text."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), T.clean_text(F.col("text")).alias("text"))
    return VL.valence_scores(docs, "text", corpus.VALENCE, corpus.NEGATIONS, corpus.VALENCE_BOOSTERS, corpus.CONTRASTS)


# ---------------------------------------------------------------- nearest reference
def _rwmd(spark, sf_dir):
    vecs = explicit_vectors(spark, sf_dir)
    docs = corpus.doc_tokens(spark, sf_dir).withColumnRenamed("id", "doc_id")
    items = table(spark, sf_dir, "benchmark", ["item_id", "text"]).select(
        "item_id", T.word_tokens(F.col("text")).alias("tokens"))
    return docs, items, vecs


_RWMD_SQL = EXPLICIT_SQL + f""",
vv AS (SELECT token, list(x ORDER BY dim) AS v FROM vec GROUP BY token),
dw0 AS (SELECT doc_id, token, count(*) AS c FROM toks JOIN vv USING (token) GROUP BY doc_id, token),
dw AS (SELECT doc_id, token, c / sum(c) OVER (PARTITION BY doc_id) AS w FROM dw0),
itoks AS (SELECT item_id, unnest({S.word_tokens('text')}) AS token FROM benchmark),
iw0 AS (SELECT item_id, token, count(*) AS c FROM itoks JOIN vv USING (token) GROUP BY item_id, token),
iw AS (SELECT item_id, token, c / sum(c) OVER (PARTITION BY item_id) AS w FROM iw0),
dist AS (SELECT a.token AS ta, b.token AS tb, list_distance(va.v, vb.v) AS dist
         FROM (SELECT DISTINCT token FROM dw) a, (SELECT DISTINCT token FROM iw) b, vv va, vv vb
         WHERE va.token = a.token AND vb.token = b.token),
imin AS (SELECT iw.item_id, dist.ta, min(dist.dist) AS m FROM iw JOIN dist ON dist.tb = iw.token GROUP BY iw.item_id, dist.ta),
lab AS (SELECT dw.doc_id, imin.item_id, sum(dw.w * imin.m) AS l_ab FROM dw JOIN imin ON imin.ta = dw.token GROUP BY dw.doc_id, imin.item_id),
dmin AS (SELECT dw.doc_id, dist.tb, min(dist.dist) AS m FROM dw JOIN dist ON dist.ta = dw.token GROUP BY dw.doc_id, dist.tb),
lba AS (SELECT dmin.doc_id, iw.item_id, sum(iw.w * dmin.m) AS l_ba FROM iw JOIN dmin ON dmin.tb = iw.token GROUP BY dmin.doc_id, iw.item_id),
rwd AS (SELECT doc_id, item_id, greatest(l_ab, l_ba) AS rwmd FROM lab JOIN lba USING (doc_id, item_id))"""


@query("relaxed_wmd", f"WITH {_RWMD_SQL} SELECT doc_id, item_id, round(rwmd, 6) + 0.0 AS rwmd FROM rwd")
def relaxed_wmd(spark, sf_dir):
    """Relaxed word mover's distance of every document to every benchmark
    item, on the explicit PPMI word vectors."""
    r = NR.relaxed_wmd(*_rwmd(spark, sf_dir))
    return r.select("doc_id", "item_id", R6(F.col("rwmd")).alias("rwmd"))


@query("nearest_argmin", f"""WITH {_RWMD_SQL}
SELECT doc_id, arg_min(item_id, (round(rwmd, 9), item_id)) AS item_id, round(min(round(rwmd, 9)), 6) + 0.0 AS rwmd
FROM rwd GROUP BY doc_id""")
def nearest_argmin(spark, sf_dir):
    """First item with the minimum distance for each document."""
    a = NR.nearest_items(*_rwmd(spark, sf_dir))
    return a.select("doc_id", "item_id", R6(F.col("rwmd")).alias("rwmd"))


@query("nearest_reference", f"""WITH {_RWMD_SQL},
best AS (SELECT doc_id, arg_min(item_id, (round(rwmd, 9), item_id)) AS item_id FROM rwd GROUP BY doc_id)
SELECT best.doc_id, best.item_id, CAST(length(b.text) AS BIGINT) AS item_chars FROM best JOIN benchmark b USING (item_id)""")
def nearest_reference(spark, sf_dir):
    """Nearest reference item of each document with the item's attributes."""
    a = NR.nearest_items(*_rwmd(spark, sf_dir))
    b = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return a.join(b, "item_id").select("doc_id", "item_id", F.length("text").cast("long").alias("item_chars"))


# ---------------------------------------------------------------- score responses
def responses(spark, sf_dir):
    """Service responses: a JSON document with the scores of a text's words,
    '-1' for a text of one word (too short to score), null for one of none."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), "text")
    words = d.select("id", F.size(T.word_tokens(F.coalesce("text", F.lit("")))).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    scored = score_responses(words, "text", keep=["n"])
    return scored.select("id", F.when(F.col("n") == 1, "-1").when(F.col("n") > 1, F.col("response")).alias("response"))


_SCORES = score_sql("text")
_RESP_SQL = f"""resp AS (SELECT id, n, CASE WHEN n = 1 THEN '-1' WHEN n > 1 THEN 'json' END AS response, {', '.join(f'{e} AS {k}' for k, e in _SCORES.items())}
  FROM (SELECT doc_id AS id, coalesce(text, '') AS text, len({S.word_tokens("coalesce(text, '')")}) AS n FROM documents))"""


@query("parse_scores", f"""WITH {_RESP_SQL}
{' UNION ALL '.join(f"SELECT id, '{k}' AS name, round({k}, 6) + 0.0 AS value FROM resp WHERE n > 1" for k in _SCORES)}""")
def parse_scores(spark, sf_dir):
    r = responses(spark, sf_dir).where(F.col("response") != "-1")
    return J.parse_scores(r, "response").select("id", "name", R6(F.col("value")).alias("value"))


@query("score_status", f"""WITH {_RESP_SQL}
SELECT id, CASE n WHEN 0 THEN 'failed' WHEN 1 THEN 'unparseable' ELSE 'ok' END AS status, round(CASE WHEN n > 1 THEN BOOSTER END, 6) + 0.0 AS booster FROM resp""")
def score_status(spark, sf_dir):
    r = J.score_status(responses(spark, sf_dir), "response")
    score = F.get_json_object(F.col("response"), "$.attributeScores.BOOSTER.summaryScore.value").cast("double")
    return r.select("id", "status", R6(F.when(F.col("status") == "ok", score)).alias("booster"))


# ---------------------------------------------------------------- metrics
def predictions(spark, sf_dir):
    """Labelled predictions from the embeddings table: true class = label,
    predicted class = index of the largest of the first ten dimensions."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    head = F.slice("embedding", 1, 10)
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"),
                    (F.array_position(head, F.array_max(head)) - 1).cast("long").alias("prediction"))


_REPORT_SQL = """cls AS (SELECT label AS c FROM res UNION SELECT prediction FROM res),
pc AS (SELECT c, (SELECT count(*) FROM res WHERE label = c AND prediction = c) AS tp,
              (SELECT count(*) FROM res WHERE label = c) AS support, (SELECT count(*) FROM res WHERE prediction = c) AS predicted FROM cls),
pm AS (SELECT c, tp, support, predicted, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM pc),
pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pm)"""
_PRED_SQL = """res AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label,
  CAST(list_position(list_slice(embedding, 1, 10), list_max(list_slice(embedding, 1, 10))) - 1 AS BIGINT) AS prediction FROM embeddings),
""" + _REPORT_SQL
_REPORT_ROWS = """
SELECT CAST(c AS VARCHAR) AS class, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(f, 6) + 0.0 AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'macro avg', round(avg(p), 6) + 0.0, round(avg(r), 6) + 0.0, round(avg(f), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6) + 0.0, round(sum(r * support) / sum(support), 6) + 0.0,
  round(sum(f * support) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM pf"""


def _rounded_report(pred):
    return M.classification_report(pred).select("class", *[R6(F.col(c)).alias(c) for c in ["precision", "recall", "f1"]],
                                                F.col("support").cast("long"))


@query("classification_report", f"WITH {_PRED_SQL}{_REPORT_ROWS}")
def classification_report(spark, sf_dir):
    return _rounded_report(predictions(spark, sf_dir))


_CLASS_NAMES = {i: f"c{i}" for i in range(10)}


def _metrics_row_sql():
    cols = []
    for v, name in _CLASS_NAMES.items():
        sel = f"c = {v}"
        cols += [f"round(max(CASE WHEN {sel} THEN support / n END), 6) + 0.0 AS \"Fraction of {name} Class\"",
                 f"round(max(CASE WHEN {sel} THEN p END), 6) + 0.0 AS \"{name} Class Precision\"",
                 f"round(max(CASE WHEN {sel} THEN r END), 6) + 0.0 AS \"{name} Class Recall\"",
                 f"round(max(CASE WHEN {sel} THEN f END), 6) + 0.0 AS \"{name} Class F1\"",
                 f"round(max(CASE WHEN {sel} THEN predicted / n END), 6) + 0.0 AS \"Fraction of Predicted {name}\""]
    return f"""WITH {_PRED_SQL}, t AS (SELECT *, sum(support) OVER () AS n FROM pf)
SELECT 'argmax' AS method, '' AS hyperparameters, {', '.join(cols)},
  round(avg(p), 6) + 0.0 AS "Macro Average Precision", round(avg(r), 6) + 0.0 AS "Macro Average Recall",
  round(sum(f * support) / sum(support), 6) + 0.0 AS "Weighted F1", round(avg(f), 6) + 0.0 AS "Macro F1" FROM t"""


@query("metrics_row", _metrics_row_sql())
def metrics_row(spark, sf_dir):
    row = M.metrics_row(predictions(spark, sf_dir), _CLASS_NAMES, "argmax", "")
    return row.select(*[R6(F.col(f"`{c}`")).alias(c) if c not in ("method", "hyperparameters") else F.col(c)
                        for c in row.columns])


@query("f1_binary", """WITH pr AS (SELECT CAST(label = 0 AS INTEGER) AS y,
  CAST(list_position(list_slice(embedding, 1, 10), list_max(list_slice(embedding, 1, 10))) = 1 AS INTEGER) AS p FROM embeddings)
SELECT round(CASE WHEN 2 * sum(y * p) + sum((1 - y) * p) + sum(y * (1 - p)) > 0
  THEN 2 * sum(y * p) / (2 * sum(y * p) + sum((1 - y) * p) + sum(y * (1 - p))) ELSE 0.0 END, 6) + 0.0 AS f1 FROM pr""")
def f1_binary(spark, sf_dir):
    """F1 of class 0 against the rest."""
    p = predictions(spark, sf_dir).select((F.col("label") == 0).cast("int").alias("label"),
                                          (F.col("prediction") == 0).cast("int").alias("prediction"))
    return M.f1_binary(p, positive=1).select(R6(F.col("f1")).alias("f1"))


# ---------------------------------------------------------------- selection
def _lexicon_features(spark, sf_dir):
    dt = corpus.doc_tokens(spark, sf_dir)
    terms = corpus.BOOSTERS + [h for h in corpus.HEDGES if not h.startswith("#")]
    lc = lexicon_counts(dt, "tokens", terms)
    return lc.select("id", F.col("term").alias("name"), F.col("n").cast("double").alias("value"))


def _task1_labels(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("task1").isNotNull())
    return p.select("id", F.when(F.col("task1") == "toxic", 1).otherwise(0).alias("label"))


_LEX_TERMS = corpus.BOOSTERS + [h for h in corpus.HEDGES if not h.startswith("#")]
_CHI_SQL = f"""lab AS (SELECT doc_id AS id, toxic AS y FROM labels),
fe AS (SELECT id, t AS name, CAST(count(*) AS DOUBLE) AS value FROM
       (SELECT doc_id AS id, unnest({S.word_tokens(S.clean_text('text'))}) AS t FROM documents)
       WHERE list_contains({S.lit_list(_LEX_TERMS)}, t) GROUP BY id, t),
obs AS (SELECT name, y, sum(value) AS o FROM fe JOIN lab USING (id) GROUP BY name, y),
cp AS (SELECT y, count(*) / (SELECT count(*) FROM lab) AS prob FROM lab GROUP BY y),
ft AS (SELECT name, sum(o) AS ftot FROM obs GROUP BY name),
chi AS (SELECT obs.name, sum(o * o / (ft.ftot * cp.prob)) - ft.ftot AS chi2 FROM obs JOIN cp USING (y) JOIN ft USING (name) GROUP BY obs.name, ft.ftot)"""


@query("chi2_feature_scores", f"WITH {_CHI_SQL} SELECT name, round(chi2, 6) + 0.0 AS chi2, chi2 > {SL.chi2_critical(0.05, 1)!r} AS selected FROM chi")
def chi2_feature_scores(spark, sf_dir):
    """Chi-square of lexicon counts against the binary label (p < 0.05)."""
    s = SL.chi2_feature_scores(_lexicon_features(spark, sf_dir), _task1_labels(spark, sf_dir), 0.05)
    return s.select("name", R6(F.col("chi2")).alias("chi2"), "selected")


@query("select_by_chi2", f"WITH {_CHI_SQL} SELECT name, round(chi2, 6) + 0.0 AS chi2, chi2 > {SL.chi2_critical(0.1, 1)!r} AS selected FROM chi")
def select_by_chi2(spark, sf_dir):
    """Keep lexicon features with p < 0.1."""
    s = SL.chi2_feature_scores(_lexicon_features(spark, sf_dir), _task1_labels(spark, sf_dir), 0.1)
    return s.select("name", R6(F.col("chi2")).alias("chi2"), "selected")


def _word_features(spark, sf_dir):
    """(id, name, value): counts of the vocabulary's words, made in the
    document's row and written once (the scores read them several times)."""
    dt = corpus.doc_tokens(spark, sf_dir)
    vocab = J.build_vocabulary(dt, "tokens", 10)
    ex = A.explode_counts(dt, "id", "tokens").join(vocab.select("token"), "token", "left_semi")
    return cut_lineage(ex.select("id", F.col("token").alias("name"), F.col("n").cast("double").alias("value")))


_NB_SQL = f"""toks AS (SELECT doc_id AS id, unnest({S.word_tokens(S.clean_text('text'))}) AS token FROM documents),
vocab AS (SELECT token FROM toks GROUP BY token HAVING count(*) > 10),
fe AS (SELECT id, token AS name, CAST(count(*) AS DOUBLE) AS value FROM toks JOIN vocab USING (token) GROUP BY id, token),
lab AS (SELECT doc_id AS id, toxic AS y FROM labels),
obs AS (SELECT name, y, sum(value) AS o FROM fe JOIN lab USING (id) GROUP BY name, y),
tc AS (SELECT y, sum(o) AS t FROM obs GROUP BY y),
vv AS (SELECT count(DISTINCT name) AS v FROM fe),
imp AS (SELECT name, (SELECT sum(ln(t + (SELECT v FROM vv))) FROM tc) - sum(ln(o + 1)) AS importance FROM obs GROUP BY name)"""


def _nb(spark, sf_dir):
    return SL.nb_feature_weights(_word_features(spark, sf_dir), _task1_labels(spark, sf_dir), mode="size")


@query("select_by_nb_weight", f"""WITH {_NB_SQL}
SELECT name, round(importance, 6) + 0.0 AS importance, importance >= (SELECT avg(importance) FROM imp) AS selected FROM imp""")
def select_by_nb_weight(spark, sf_dir):
    """Naive Bayes size score per word, kept when at least the mean."""
    s = SL.select_by_weight(_nb(spark, sf_dir), "mean")
    return s.select("name", R6(F.col("importance")).alias("importance"), "selected")


@query("top_terms_by_weight", f"""WITH {_NB_SQL}
SELECT name, round(importance, 6) + 0.0 AS importance FROM imp ORDER BY importance DESC, name LIMIT 1000""")
def top_terms_by_weight(spark, sf_dir):
    """At most 1,000 words by naive Bayes score (the operator's own cap)."""
    t = SL.top_terms_by_weight(_nb(spark, sf_dir), 1000)
    return t.select("name", R6(F.col("importance")).alias("importance"))


@query("count_vectorize", r"""
WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[\s\x{0B}\x{85}\p{Z}][\s\x{0B}\x{85}\p{Z}]+', ' ', 'g') AS s FROM documents),
g AS (SELECT doc_id, substring(s, p, n) AS term
      FROM t, (VALUES (3), (4)) v(n), LATERAL (SELECT unnest(range(1, length(s) - n + 2)) AS p)),
pd AS (SELECT term, doc_id, count(*) AS c FROM g GROUP BY term, doc_id),
v AS (SELECT term, count(*) AS df, sum(c) AS tf FROM pd GROUP BY term)
SELECT term, df, CAST(tf AS BIGINT) AS tf FROM v
WHERE df >= 0.1 * (SELECT count(*) FROM documents) AND df <= 0.5 * (SELECT count(*) FROM documents)""")
def count_vectorize(spark, sf_dir):
    """Character 3-4 gram vocabulary with min_df 0.1 and max_df 0.5."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    g = char_ngram_counts(d, "text", 3, 4).select(F.col("ngram").alias("term"), F.col("n_docs").alias("df"), F.col("cnt").alias("tf"))
    v = SL.document_frequency_vocabulary(d, "text", min_df=0.1, max_df=0.5, counted=g)
    return v.select("term", "df", F.col("tf").cast("long").alias("tf"))


_SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("scale_features", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round((({c}) - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in _SCALE_COLS) + " FROM lineitem")
def scale_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"] + _SCALE_COLS)
    z = SL.scale_features(li, _SCALE_COLS)
    return z.select("l_orderkey", "l_linenumber", *[R6(F.col(c)).alias(c) for c in _SCALE_COLS])


@query("class_weights", f"""WITH {S.POSTS}, l AS (SELECT id, task2 FROM posts WHERE task2 IS NOT NULL),
c AS (SELECT task2, count(*) AS nc FROM l GROUP BY task2)
SELECT l.id, l.task2, round((SELECT count(*) FROM l) / ((SELECT count(*) FROM c) * c.nc), 6) + 0.0 AS weight FROM l JOIN c USING (task2)""")
def class_weights(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("task2").isNotNull()).select("id", "task2")
    w = SL.class_weights(p, "task2")
    return w.select("id", "task2", R6(F.col("weight")).alias("weight"))


# ---------------------------------------------------------------- rows-only: selectors on numeric data
_LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li_labelled(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"] + _LI_COLS)
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *_LI_COLS,
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))


def _vif_sql() -> str:
    """Variance inflation factors in closed form: the diagonal of the inverse of
    a correlation matrix of at most four columns, as minors over the determinant."""
    def det(cols):
        r = lambda i, j: f"r{min(i, j)}{max(i, j)}"
        pairs = [(i, j) for i in cols for j in cols if i < j]
        out = "1 - (" + " + ".join(["0"] + [f"{r(*p)} * {r(*p)}" for p in pairs]) + ")"
        for a in cols:
            for b in cols:
                for c in cols:
                    if a < b < c:
                        out += f" + 2 * {r(a, b)} * {r(b, c)} * {r(a, c)}"
        if len(cols) == 4:
            p, q, t, u = cols
            out += "".join(f" + pow({r(*x)} * {r(*y)}, 2)" for x, y in (((p, q), (t, u)), ((p, t), (q, u)), ((p, u), (q, t))))
            out += "".join(f" - 2 * {r(a, b)} * {r(b, c)} * {r(c, d)} * {r(d, a)}" for a, b, c, d in ((p, q, t, u), (p, q, u, t), (p, t, q, u)))
        return f"({out})"

    def vif(i, cols):
        return f"({det([c for c in cols if c != i])} / {det(cols)})"

    def kept(cols):
        if len(cols) == 1:
            return str(cols)
        top = "greatest(" + ", ".join(vif(i, cols) for i in cols) + ")"
        drop = " ".join(f"WHEN {vif(i, cols)} = {top} THEN {kept([c for c in cols if c != i])}" for i in cols)
        return f"CASE WHEN {top} <= 5 THEN {cols} {drop} END"

    every = list(range(len(_LI_COLS)))
    r = ", ".join(f"corr({_LI_COLS[i]}, {_LI_COLS[j]}) AS r{i}{j}" for i in every for j in every if i < j)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS name, round({vif(i, every)}, 6) + 0.0 AS vif, list_contains(kept, {i}) AS kept FROM k"
                              for i, c in enumerate(_LI_COLS))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in _LI_COLS)
    return f"WITH m AS (SELECT {r} FROM lineitem WHERE {whole}), k AS (SELECT *, {kept(every)} AS kept FROM m) {rows}"


@query("vif_filter", _vif_sql())
def vif_filter(spark, sf_dir):
    v = SL.vif_filter(table(spark, sf_dir, "lineitem", _LI_COLS), _LI_COLS, threshold=5.0)
    return v.select("name", R6(F.col("vif")).alias("vif"), "kept")


@query("select_by_tree_importance")
def select_by_tree_importance(spark, sf_dir):
    return SL.select_by_tree_importance(_li_labelled(spark, sf_dir), _LI_COLS, "label")


@query("select_by_l1")
def select_by_l1(spark, sf_dir):
    return SL.select_by_l1(_li_labelled(spark, sf_dir), _LI_COLS, "label")


@query("select_by_elimination")
def select_by_elimination(spark, sf_dir):
    return SL.select_by_elimination(_li_labelled(spark, sf_dir), _LI_COLS, "label", key="id", folds=3,
                                    min_features=2)


@query("selection_report")
def selection_report(spark, sf_dir):
    """Cross-validated F1 before and after tree-importance selection."""
    data = cut_lineage(WN.stratified_folds(_li_labelled(spark, sf_dir), "label", 3))  # read by each fit
    sel = [r["name"] for r in SL.select_by_tree_importance(data, _LI_COLS, "label").where("selected").collect()]
    rows = []
    for name, cols in [("all", _LI_COLS), ("selected", sel or _LI_COLS)]:
        from pyspark.ml.feature import VectorAssembler
        pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"),
                                MD.fit_rf(n_trees=10, max_depth=5)])
        pred = MD.cv_predict(pipe, data.withColumn("label", F.col("label").cast("double")), "fold")
        rep = M.classification_report(pred).where(F.col("class") == "macro avg").select(
            F.lit(name).alias("features"), F.lit(len(cols)).alias("n_features"), F.col("f1").alias("macro_f1"))
        rows.append(rep)
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------- rows-only: text models
def _text_data(spark, sf_dir, task: str = "task1", k: int = 3):
    """(id, text, grams, label, fold) of the labelled posts, written once but
    for the n-grams: a text has about twice as many as characters, and a
    reader's batch of stored arrays (4,096 rows) would hold those of all its
    rows at once.  They are made in the row again by each pass."""
    idx = {n: i for i, n in enumerate(sorted(set(corpus.TASK1_NAMES.values()) if task == "task1"
                                             else corpus.TASK2_NAMES))}
    lab_col = F.lit(None).cast("double")
    for n, i in idx.items():
        lab_col = F.when(F.col(task) == n, F.lit(float(i))).otherwise(lab_col)
    lab = corpus.posts_labels(spark, sf_dir).where(F.col(task).isNotNull()).select("id", lab_col.alias("label"))
    folds = cut_lineage(WN.stratified_folds(lab, "label", k))
    texts = table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    return MD.add_char_ngrams(cut_lineage(spread(texts.join(folds, "id"))), "text", 3, 4)


_NB_GRAMS_SQL = rf"""lab AS (SELECT doc_id AS id, CAST(toxic AS DOUBLE) AS label FROM labels),
fold AS (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {S.phash('id')}, id) - 1) % 3 AS fold FROM lab),
t AS (SELECT doc_id AS id, regexp_replace(lower(text), '[\s\x{{0B}}\x{{85}}\p{{Z}}][\s\x{{0B}}\x{{85}}\p{{Z}}]+', ' ', 'g') AS s FROM documents),
g AS MATERIALIZED (SELECT id, substring(s, p, n) AS term, count(*) AS c
      FROM t, (VALUES (3), (4)) v(n), LATERAL (SELECT unnest(range(1, length(s) - n + 2)) AS p) GROUP BY ALL)"""


def _nb_sql(train: str, target: str) -> str:
    """Naive Bayes predictions nb(k, id, prediction): ``train`` has the
    (k, id, label) that model k learns from, ``target`` the (k, id) it scores."""
    return _NB_GRAMS_SQL + f""",
tr AS ({train}), ta AS ({target}),
n AS (SELECT k, count(*) AS n FROM tr GROUP BY k),
v AS MATERIALIZED (SELECT tr.k, g.term FROM tr JOIN g USING (id) JOIN n USING (k) GROUP BY tr.k, g.term, n.n HAVING count(*) >= 0.1 * n.n AND count(*) <= 0.5 * n.n),
o AS MATERIALIZED (SELECT tr.k, tr.label, g.term, sum(g.c) AS o FROM tr JOIN g USING (id) JOIN v ON v.k = tr.k AND v.term = g.term GROUP BY ALL),
pr AS (SELECT k, label, ln(count(*) + 1.0) - ln((SELECT n FROM n WHERE n.k = tr.k) + (SELECT count(DISTINCT label) FROM tr) * 1.0) AS prior FROM tr GROUP BY k, label),
tc AS (SELECT k, label, sum(o) + (SELECT count(*) FROM v WHERE v.k = o.k) AS tc FROM o GROUP BY k, label),
th AS MATERIALIZED (SELECT v.k, tc.label, v.term, ln(coalesce(o.o, 0) + 1.0) - ln(tc.tc) AS th FROM v JOIN tc ON tc.k = v.k
       LEFT JOIN o ON o.k = v.k AND o.label = tc.label AND o.term = v.term),
li AS (SELECT ta.k, ta.id, th.label, sum(g.c * th.th) AS li FROM ta JOIN g USING (id) JOIN th ON th.k = ta.k AND th.term = g.term GROUP BY ALL),
nb AS (SELECT ta.k, ta.id, arg_max(pr.label, pr.prior + coalesce(li.li, 0.0)) AS prediction
       FROM ta JOIN pr ON pr.k = ta.k LEFT JOIN li ON li.k = ta.k AND li.id = ta.id AND li.label = pr.label GROUP BY ta.k, ta.id)"""


_CV_NB_SQL = _nb_sql("SELECT k, id, label FROM fold, (VALUES (0), (1), (2)) x(k) WHERE fold <> k", "SELECT fold AS k, id FROM fold")
# model 3 learns from all labelled posts
_HOLDOUT_SQL = f"""(SELECT id, label, row_number() OVER (PARTITION BY lang, quality, toxic ORDER BY {S.phash('id')}, id) > round(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY lang, quality, toxic)) AS learn
  FROM lab JOIN (SELECT doc_id AS id, quality, toxic FROM labels) q USING (id) JOIN (SELECT doc_id AS id, lang FROM documents) d USING (id))"""
_HOLDOUT_NB_SQL = _nb_sql(f"SELECT 0 AS k, id, label FROM {_HOLDOUT_SQL} WHERE learn", f"SELECT 0 AS k, id FROM {_HOLDOUT_SQL} WHERE NOT learn")
_NB_RESULT_SQL = ", res AS MATERIALIZED (SELECT nb.id, lab.label, nb.prediction FROM nb JOIN lab USING (id)), " + _REPORT_SQL + _REPORT_ROWS
_CV_AND_FULL_NB_SQL = _nb_sql("SELECT k, id, label FROM fold, (VALUES (0), (1), (2), (3)) x(k) WHERE fold <> k",
                              "SELECT fold AS k, id FROM fold UNION ALL SELECT 3 AS k, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def _train_rows(data, k: int = 3) -> int:
    """Rows of a training part; penalties are per row."""
    return max(1, data.count() * (k - 1) // k)


def _cv_report(pipe, data):
    pred = MD.cv_predict(pipe, data, "fold")
    return M.classification_report(pred)


def _stages(**kw):
    return MD.text_pipeline_stages(3, 4, 0.1, 0.5, **kw)


@query("assemble_pipeline")
def assemble_pipeline(spark, sf_dir):
    """Text branch (character n-gram counts, chosen by naive Bayes) +
    pass-through numeric branch -> classifier; out-of-fold report."""
    data = _text_data(spark, sf_dir).withColumn("n_chars", F.length("text").cast("double"))
    pipe = Pipeline(stages=_stages(numeric=["n_chars"], select="mean") + [MD.fit_lr(C=1.0, n_rows=_train_rows(data))])
    return _cv_report(pipe, data)


@query("fit_nb", f"WITH {_CV_NB_SQL}{_NB_RESULT_SQL}")
def fit_nb(spark, sf_dir):
    return _rounded_report(MD.cv_predict(Pipeline(stages=_stages() + [MD.fit_nb()]), _text_data(spark, sf_dir), "fold"))


@query("fit_rf")
def fit_rf(spark, sf_dir):
    return _cv_report(Pipeline(stages=_stages() + [MD.fit_rf()]), _text_data(spark, sf_dir))


@query("fit_lr")
def fit_lr(spark, sf_dir):
    data = _text_data(spark, sf_dir)
    return _cv_report(Pipeline(stages=_stages(scale=True) + [MD.fit_lr(C=0.1, n_rows=_train_rows(data))]), data)


@query("fit_linear_svm")
def fit_linear_svm(spark, sf_dir):
    """Six-class style: one-vs-rest linear SVM on the four-class label."""
    data = _text_data(spark, sf_dir, "task2")
    return _cv_report(Pipeline(stages=_stages(scale=True) + [MD.fit_linear_svm(C=0.01, n_rows=_train_rows(data), multiclass=True)]),
                      data)


@query("fit_kernel_svm")
def fit_kernel_svm(spark, sf_dir):
    """RBF kernel approximated by random Fourier features, then a linear SVM."""
    data = _text_data(spark, sf_dir)
    feat = MD.fit_stages(Pipeline(stages=_stages(scale=True)), data).transform(data)
    dim = feat.select("features").first()[0].size
    # dense vectors of all the terms cross to Python, few rows at a time; 100 numbers a row are kept
    rff = cut_lineage(MD.random_fourier_features(feat, "features", "rff", dim, n_components=100).select("id", "label", "fold", F.col("rff").alias("features")))
    out = None
    for f in range(3):
        m = MD.fit_kernel_svm(C=1.0, n_rows=_train_rows(data)).fit(rff.where(F.col("fold") != f))
        p = m.transform(rff.where(F.col("fold") == f)).select("id", "label", "prediction")
        out = p if out is None else out.unionByName(p)
    return M.classification_report(out)


@query("cv_predict", f"WITH {_CV_NB_SQL} SELECT nb.id, fold.label, nb.prediction FROM nb JOIN fold USING (id)")
def cv_predict(spark, sf_dir):
    """Out-of-fold prediction for every labelled post (each id once)."""
    data = _text_data(spark, sf_dir)
    return MD.cv_predict(Pipeline(stages=_stages() + [MD.fit_nb()]), data, "fold")


def _leader(cv, grid):
    rows = [(str({p.name: v for p, v in m.items()}), float(s)) for m, s in zip(grid, cv.avgMetrics)]
    return rows


@query("grid_search")
def grid_search(spark, sf_dir):
    """The reference's 20 maps of logistic regression, five folds, by accuracy."""
    data = _text_data(spark, sf_dir, k=5)
    last, grid = MD.weighted_grids(_train_rows(data, 5))["lr"]
    cv = MD.grid_search(Pipeline(stages=_stages(scale=True) + last), grid, data, metric="accuracy")
    return spark.createDataFrame(_leader(cv, grid), "params string, score double").orderBy(F.desc("score"))


@query("random_search")
def random_search(spark, sf_dir):
    """100 of the reference's 864 maps, five folds."""
    data = _text_data(spark, sf_dir, k=5)
    forest = MD.BalancedForest()
    cv = MD.random_search(Pipeline(stages=_stages() + [forest]), MD.forest_grid(forest), data)
    maps = cv.getEstimatorParamMaps()
    return spark.createDataFrame(_leader(cv, maps), "params string, score double").orderBy(F.desc("score"))


@query("successive_halving")
def successive_halving(spark, sf_dir):
    """The reference's 192 maps; five rounds (1/81 of the rows first), or fewer
    where 1/81 is less than 24 rows."""
    data = _text_data(spark, sf_dir)
    data = data.withColumns({"grams_3_4": F.array_distinct("grams"), "grams_2_5": F.array_distinct(T.char_ngrams(F.col("text"), 2, 5))})
    pipe, grid = MD.halving_search(["grams_2_5", "grams_3_4"])
    return MD.successive_halving(pipe, grid, data, key="id", min_fraction=min(1.0, max(1 / 81, 24 / max(data.count(), 1))))


@query("model_search")
def model_search(spark, sf_dir):
    """The reference's grids of linear SVM and forests beside naive Bayes and two
    maps of logistic regression (whose 20 are ``grid_search``), by accuracy."""
    data = _text_data(spark, sf_dir)
    nb = MD.fit_nb()
    cands = [("nb", Pipeline(stages=_stages() + [nb]), ParamGridBuilder().addGrid(nb.smoothing, [0.01, 0.001]).build())]
    for name, (last, grid) in MD.weighted_grids(_train_rows(data)).items():
        grid = [m for m in grid if m.get(last[-1].elasticNetParam) == 0.0][2:4] if name == "lr" else grid
        cands.append((name, Pipeline(stages=_stages(scale=name != "rf") + last), grid))
    return MD.model_search(cands, data, metric="accuracy")


@query("stack_predictions", f"WITH {_CV_AND_FULL_NB_SQL} SELECT id, 'char_prediction' AS name, prediction AS value FROM nb")
def stack_predictions(spark, sf_dir):
    """Character-model prediction as a feature: out-of-fold on train,
    full fit on test."""
    train = _text_data(spark, sf_dir)
    test = MD.add_char_ngrams(corpus.posts(spark, sf_dir).where(F.col("split") == "test").select("id", "text"))
    return MD.stack_predictions(Pipeline(stages=_stages() + [MD.fit_nb()]), train, test)


def _scratch(spark, name):
    """A folder of this call's own."""
    return f"{ensure_checkpoint_dir(spark)}/textmill-out/{uuid.uuid4().hex}/{name}"


@query("batch_score", f"WITH {_CV_AND_FULL_NB_SQL} SELECT 'run' AS test_case, printf('%06d', id) AS id, printf('%.1f', prediction) AS prediction FROM nb WHERE k = 3")
def batch_score(spark, sf_dir):
    """Fit, save, reload and score every post; submission rows for test."""
    train = _text_data(spark, sf_dir)
    model = MD.fit_stages(Pipeline(stages=_stages() + [MD.fit_nb()]), train)
    path = _scratch(spark, "model")
    SK.save_model(model, path)
    reloaded = SK.load_model(path)
    allp = MD.add_char_ngrams(corpus.posts(spark, sf_dir).select("id", "text", "split"))
    scored = MD.batch_score(reloaded, allp, ["split"])
    return SK.submission_frame(scored.where(F.col("split") == "test"), test_case=_TEST_CASE)


@query("subset_search")
def subset_search(spark, sf_dir):
    """Every subset of at least three booster counts, by hold-out and
    cross-validated F1."""
    names = sorted(corpus.BOOSTERS)
    wide = J.join_features(_task1_labels(spark, sf_dir), _lexicon_features(spark, sf_dir), names).na.fill(0.0)
    data = cut_lineage(WN.stratified_split(WN.stratified_folds(wide, "label", 5), "label", 0.2))
    train, held = (data.where(F.col("split") == part) for part in ("train", "test"))
    return MD.subset_search(train, held, names, min_size=3)


@query("rank_feature_subsets", """WITH f AS (SELECT source AS name, row_number() OVER (ORDER BY source) - 1 AS bit FROM (SELECT DISTINCT source FROM documents)),
m AS (SELECT range AS mask FROM range(CAST(pow(2, (SELECT count(*) FROM f)) AS BIGINT)) WHERE bit_count(range) >= (SELECT count(*) FROM f) - 2),
c AS (SELECT source, count(*) AS n, sum(toxic) AS pos FROM labels JOIN documents USING (doc_id) GROUP BY source),
s AS (SELECT m.mask, count(*) AS size, string_agg(f.name, ',' ORDER BY f.bit) AS members, sum(coalesce(c.pos, 0)) AS tp, sum(coalesce(c.n, 0)) AS predicted
      FROM m JOIN f ON (m.mask >> f.bit) & 1 = 1 LEFT JOIN c ON c.source = f.name GROUP BY m.mask)
SELECT mask, CAST(size AS INTEGER) AS size, members, round(2 * tp / (predicted + (SELECT sum(pos) FROM c)), 6) + 0.0 AS f1
FROM s ORDER BY f1 DESC, mask LIMIT 10""")
def rank_feature_subsets(spark, sf_dir):
    """The ten best subsets of sources by the F1 of the rule that a post of
    these sources is toxic."""
    posts = corpus.posts_labels(spark, sf_dir).select("id", (F.col("task1") == "toxic").cast("int").alias("y"))
    src = table(spark, sf_dir, "documents", ["doc_id", "source"]).select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    counts = src.join(posts, "id").groupBy("name").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    subsets = q_relational.feature_subsets(spark, sf_dir)
    parts = subsets.select("*", A.explode(F.split("members", ",")).alias("name")).join(counts, "name", "left")
    total = counts.agg(F.sum("pos").alias("all"))
    scored = (parts.groupBy("mask", "size", "members").agg(F.sum(F.coalesce("pos", F.lit(0))).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).alias("predicted"))
              .join(F.broadcast(total), how="inner")
              .select("mask", "size", "members", R6(2 * F.col("tp") / (F.col("predicted") + F.col("all"))).alias("f1")))
    return SO.rank_subsets(scored, "f1", 10, "mask")


@query("holdout_report", f"WITH {_HOLDOUT_NB_SQL}{_NB_RESULT_SQL}")
def holdout_report(spark, sf_dir):
    """Fit on train minus validation (20 % hold-out of the same mix of language
    and four-class label), report on the validation part."""
    data = _text_data(spark, sf_dir)
    # ranked by id and stratum alone: texts and n-grams stay where they are
    lang = table(spark, sf_dir, "documents", ["doc_id", "lang"]).withColumnRenamed("doc_id", "id")
    strata = data.select("id").join(corpus.posts_labels(spark, sf_dir), "id").join(lang, "id").select("id", T.compose_key(F.col("lang"), F.col("task2")).alias("label"))
    parts = cut_lineage(WN.stratified_split(strata, "label", 0.2).drop("label"))
    split = data.drop("fold").join(parts, "id")
    model = MD.fit_stages(Pipeline(stages=_stages() + [MD.fit_nb()]), split.where(F.col("split") == "train"))
    return _rounded_report(cut_lineage(model.transform(split.where(F.col("split") == "test")).select("id", "label", "prediction")))


@query("word_clusters")
def word_clusters(spark, sf_dir):
    """Batch self-organising map (32 x 32) over the explicit PPMI vectors."""
    return CL.batch_som(explicit_vectors(spark, sf_dir))


# ---------------------------------------------------------------- sinks (write, read back)
_TEST_CASE = "run"  # the constant first column of a run file
_LEX_FEATURES_SQL = f"""SELECT id, t AS name, CAST(count(*) AS DOUBLE) AS value FROM
  (SELECT doc_id AS id, unnest({S.word_tokens(S.clean_text('text'))}) AS t FROM documents)
WHERE list_contains({S.lit_list(_LEX_TERMS)}, t) GROUP BY id, t"""


@query("sink_features", _LEX_FEATURES_SQL)
def sink_features(spark, sf_dir):
    """Write the lexicon feature to the long store, read it back."""
    root = _scratch(spark, "features")
    SK.sink_features(_lexicon_features(spark, sf_dir), root, "documents", "lexicon")
    return scan_features(spark, root, "documents", "lexicon")


@query("scan_features", _LEX_FEATURES_SQL)
def scan_features_q(spark, sf_dir):
    """Read one feature of a store holding two (partition pruning)."""
    root = _scratch(spark, "features_scan")
    SK.sink_features(_lexicon_features(spark, sf_dir), root, "documents", "lexicon")
    SK.sink_features(_lexicon_features(spark, sf_dir).withColumn("value", F.col("value") * 2), root, "documents", "double")
    return scan_features(spark, root, "documents", "lexicon")


@query("sink_submission", f"""SELECT '{_TEST_CASE}' AS test_case, printf('%06d', d.doc_id) AS id,
  CASE WHEN length(d.text) > 2000 THEN 'toxic' ELSE 'non-toxic' END AS prediction
FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def sink_submission(spark, sf_dir):
    """Run file for the test posts, read back (all columns strings)."""
    p = corpus.posts(spark, sf_dir).where(F.col("split") == "test")
    pred = p.select("id", F.when(F.length("text") > 2000, "toxic").otherwise("non-toxic").alias("prediction"))
    path = SK.sink_submission(pred, _scratch(spark, "runs"), "task1", "team", "1", "", test_case=_TEST_CASE)
    return spark.read.option("sep", "\t").csv(path).toDF("test_case", "id", "prediction")


@query("sink_submission_const", f"""SELECT '{_TEST_CASE}' AS test_case, printf('%06d', doc_id) AS id,
  'non-toxic' AS prediction FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def sink_submission_const(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).where(F.col("split") == "test")
    pred = p.select("id", F.lit("non-toxic").alias("prediction"))
    path = _scratch(spark, "runs_const")
    SK.sink_submission_const(pred, path, _TEST_CASE, sep=",")
    return spark.read.csv(path).toDF("test_case", "id", "prediction")


@query("sink_metrics", _metrics_row_sql())
def sink_metrics(spark, sf_dir):
    path = _scratch(spark, "metrics")
    SK.sink_metrics(spark, M.metrics_row(predictions(spark, sf_dir), _CLASS_NAMES, "argmax", ""), path)
    row = spark.read.option("sep", "\t").option("header", True).csv(path)
    return row.select(*[R6(F.col(f"`{c}`").cast("double")).alias(c) if c not in ("method", "hyperparameters")
                        else F.coalesce(c, F.lit("")).alias(c) for c in row.columns])


@query("sink_split", "SELECT doc_id AS id, lang AS language, 'test' AS split FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sink_split(spark, sf_dir):
    p = corpus.posts(spark, sf_dir).select("id", "language", "split")
    path = _scratch(spark, "split")
    SK.sink_split(p, path)
    return spark.read.parquet(path).where(F.col("split") == "test")


@query("sink_translated", ORACLES["translate_lookup"])
def sink_translated(spark, sf_dir):
    from textmill.plans.q_relational import translated_posts
    path = _scratch(spark, "translated")
    SK.sink_translated(translated_posts(spark, sf_dir).select("id", "language", "translated_text"), path)
    return spark.read.parquet(path)


@query("save_model", "SELECT doc_id AS id, true AS same FROM labels")
def save_model(spark, sf_dir):
    """Saved and reloaded model predicts the same as the fitted one."""
    data = _text_data(spark, sf_dir)
    model = MD.fit_stages(Pipeline(stages=_stages() + [MD.fit_nb()]), data)
    path = _scratch(spark, "saved_model")
    SK.save_model(model, path)
    a = model.transform(data).select("id", F.col("prediction").alias("p1"))
    b = SK.load_model(path).transform(data).select("id", F.col("prediction").alias("p2"))
    return a.join(b, "id").select("id", (F.col("p1") == F.col("p2")).alias("same"))


@query("sink_token_vectors", ORACLES["scan_token_vectors"])
def sink_token_vectors(spark, sf_dir):
    tv = J.token_vectors_from_embeddings(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), 8)
    path = _scratch(spark, "token_vectors")
    SK.sink_token_vectors(tv, path)
    return spark.read.parquet(path).select("id", "pos", A.posexplode("vec").alias("dim", "value")).select(
        "id", "pos", "dim", R6(F.col("value").cast("double")).alias("value"))


@query("scan_word_vectors", f"WITH {EXPLICIT_SQL} SELECT token, CAST(count(*) AS INTEGER) AS dims FROM vec GROUP BY token")
def scan_word_vectors(spark, sf_dir):
    """Load a (token, vec) word-vector table: the explicit PPMI vectors of
    the corpus written as Parquet, then read with the scanner."""
    from textmill.sources.files import scan_word_vectors as scan
    path = _scratch(spark, "word_vectors")
    explicit_vectors(spark, sf_dir).write.mode("overwrite").parquet(path)
    wv = scan(spark, path)
    return wv.select("token", F.size("vec").alias("dims"))
