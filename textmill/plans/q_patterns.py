"""Queries for dependency-pattern mining.

Parameters follow the reference run (alpha 2, minimum frequency 10, n up to
4); the oracle unrolls the growth loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import patterns as P
from textmill.plans import corpus
from textmill.plans import sqlparts as S
from textmill.plans.registry import query
from textmill.session import cut_lineage

MIN_N, MAX_N, ALPHA, MIN_FREQ = 1, 4, 2.0, 10
LABELS = sorted({lab for _, lab in corpus.PHRASES})


def R6(c):
    return F.round(c, 6) + F.lit(0.0)


def _pstr(c):
    return F.array_join(c, "|")


def phrases_df(spark):
    return spark.createDataFrame(corpus.PHRASES, "phrase string, label string")


def _spans(spark, sf_dir):
    """Sentences with their phrase spans."""
    return P.match_phrases(corpus.sentence_tokens(spark, sf_dir), phrases_df(spark))


def coded_tokens(spark, sf_dir):
    """Sentences of merged and coded tokens; nothing moves up to here."""
    return P.assign_cluster(P.merge_phrases(_spans(spark, sf_dir)))


_PH_VALUES = ", ".join(f"('{p}', '{lab}')" for p, lab in corpus.PHRASES)

MERGED = S.TOKENS + f""",
phrases AS (SELECT * FROM (VALUES {_PH_VALUES}) v(text, label)),
cand2 AS (SELECT a.doc_id, a.sent_id, a.i AS start, p.label FROM tokens a
          JOIN tokens b ON b.doc_id = a.doc_id AND b.sent_id = a.sent_id AND b.i = a.i + 1
          JOIN phrases p ON p.text = lower(a.form) || ' ' || lower(b.form)),
r2 AS (SELECT *, start - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY start) AS grp FROM cand2),
r2b AS (SELECT *, min(start) OVER (PARTITION BY doc_id, sent_id, grp) AS run0 FROM r2),
take2 AS (SELECT doc_id, sent_id, start, 2 AS len, label FROM r2b WHERE (start - run0) % 2 = 0),
cand1 AS (SELECT a.doc_id, a.sent_id, a.i AS start, p.label FROM tokens a JOIN phrases p ON p.text = lower(a.form)),
take1 AS (SELECT c.doc_id, c.sent_id, c.start, 1 AS len, c.label FROM cand1 c
          WHERE NOT EXISTS (SELECT 1 FROM take2 t WHERE t.doc_id = c.doc_id AND t.sent_id = c.sent_id
                            AND c.start BETWEEN t.start AND t.start + 1)),
spans AS (SELECT * FROM take2 UNION ALL SELECT * FROM take1),
mt AS (SELECT t.doc_id, t.sent_id, t.i, t.form, t.lemma, coalesce(inn.start, t.head) AS head, sp.label AS canon,
              coalesce(sp.label, t.lemma, 'None') AS code
       FROM tokens t
       LEFT JOIN spans sp ON sp.doc_id = t.doc_id AND sp.sent_id = t.sent_id AND sp.start = t.i
       LEFT JOIN take2 inn ON inn.doc_id = t.doc_id AND inn.sent_id = t.sent_id AND inn.start + 1 = t.head
       WHERE NOT EXISTS (SELECT 1 FROM take2 x WHERE x.doc_id = t.doc_id AND x.sent_id = t.sent_id AND x.start + 1 = t.i))"""


def _grow_sql(prev: str, new: str) -> str:
    return f"""m_{prev} AS (SELECT doc_id, sent_id, gram, unnest(gram) AS head FROM {prev}),
{new} AS (SELECT DISTINCT m.doc_id, m.sent_id, list_sort(list_append(m.gram, c.i)) AS gram
        FROM m_{prev} m JOIN mt c ON c.doc_id = m.doc_id AND c.sent_id = m.sent_id AND c.head = m.head
        WHERE NOT list_contains(m.gram, c.i))"""


def _enc_sql(src: str, name: str) -> str:
    return f"""{name} AS (SELECT e.doc_id, e.sent_id, e.gram, len(e.gram) AS n, list_sort(list(mt.code)) AS pattern
        FROM (SELECT doc_id, sent_id, gram, unnest(gram) AS i FROM {src}) e
        JOIN mt ON mt.doc_id = e.doc_id AND mt.sent_id = e.sent_id AND mt.i = e.i
        GROUP BY e.doc_id, e.sent_id, e.gram)"""


def _score_sql(enc: str, up: str, name: str) -> str:
    """(n, pattern, cnt, p, keep) for the encoded occurrences ``enc``."""
    return f"""c_{name} AS (SELECT n, pattern, count(*) AS cnt FROM {enc} GROUP BY n, pattern),
t_{name} AS (SELECT n, sum(cnt) AS tot FROM c_{name} GROUP BY n),
p_{name} AS (SELECT c.n, c.pattern, c.cnt, c.cnt / t.tot AS p FROM c_{name} c JOIN t_{name} t USING (n)),
pp_{name} AS (SELECT pattern, product(up.p) AS pprod FROM (SELECT pattern, unnest(pattern) AS code FROM p_{name} WHERE n > 1) x
              JOIN {up} up USING (code) GROUP BY pattern),
{name} AS (SELECT p.*, (p.n = 1 OR p.p >= {ALPHA} * pp.pprod) AS keep FROM p_{name} p LEFT JOIN pp_{name} pp USING (pattern))"""


GROWN = MERGED + """,
g1 AS (SELECT doc_id, sent_id, [i] AS gram FROM mt),
""" + _grow_sql("g1", "g2") + ",\n" + _grow_sql("g2", "g3") + ",\n" + _grow_sql("g3", "g4") + """,
gall AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4),
""" + _enc_sql("gall", "enc")

SCORED = GROWN + """,
up AS (SELECT pattern[1] AS code, cnt / (SELECT sum(cnt) FROM (SELECT count(*) AS cnt FROM enc WHERE n = 1 GROUP BY pattern)) AS p
       FROM (SELECT pattern, count(*) AS cnt FROM enc WHERE n = 1 GROUP BY pattern)),
""" + _score_sql("enc", "up", "sc")


def _final_sql(kept: str) -> str:
    return f"""subs AS (SELECT DISTINCT list_filter(pattern, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS sub
        FROM (SELECT pattern, unnest(range(1, (1 << len(pattern)) - 1)) AS m FROM {kept} WHERE len(pattern) >= 2)),
fin AS (SELECT DISTINCT pattern FROM {kept} k WHERE NOT EXISTS (SELECT 1 FROM subs s WHERE s.sub = k.pattern)),
ids AS (SELECT pattern, row_number() OVER (ORDER BY pattern) - 1 AS pid FROM fin)"""


FINAL = SCORED + f""",
kept AS (SELECT pattern FROM sc WHERE cnt >= {MIN_FREQ} AND n >= {MIN_N} AND keep),
""" + _final_sql("kept")


def _mined(spark, sf_dir):
    return P.mine_collocations(coded_tokens(spark, sf_dir), MIN_N, MAX_N, ALPHA, MIN_FREQ)


@query("match_phrases", f"WITH {MERGED} SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len, label FROM spans")
def match_phrases(spark, sf_dir):
    """Dictionary phrases (case-insensitive), longest then earliest,
    non-overlapping."""
    return P.span_rows(_spans(spark, sf_dir)).select("doc_id", F.col("sent_id").cast("int"), F.col("start").cast("int"),
                        F.col("len").cast("int"), "label")


@query("assign_cluster", f"WITH {MERGED} SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(i AS INTEGER) AS i, CAST(head AS INTEGER) AS head, code FROM mt")
def assign_cluster(spark, sf_dir):
    """Merged tokens with code = phrase label, else cluster (lemma in the
    unclustered mode), else 'None'."""
    t = P.token_rows(coded_tokens(spark, sf_dir))
    return t.select("doc_id", F.col("sent_id").cast("int"), F.col("i").cast("int"),
                    F.col("head").cast("int"), "code")


@query("grow_connected_ngrams", f"WITH {GROWN} SELECT doc_id, CAST(len(gram) AS INTEGER) AS n, count(*) AS cnt FROM gall GROUP BY doc_id, len(gram)")
def grow_connected_ngrams(spark, sf_dir):
    """Connected n-grams (n = 1..4) over the dependency tree, per document."""
    sents = P.eligible(coded_tokens(spark, sf_dir))
    small = F.transform("t", lambda x: F.struct(x["i"].alias("i"), x["head"].alias("head")))
    g = P.unigrams(sents.select("doc_id", small.alias("t"))).withColumn("sizes", F.array(F.size("grams")))
    for _ in range(2, MAX_N + 1):
        g = P.grow_connected_ngrams(g).withColumn("sizes", F.concat("sizes", F.array(F.size("grams"))))
    sizes = g.select("doc_id", F.posexplode("sizes").alias("k", "cnt")).where(F.col("cnt") > 0)
    return sizes.groupBy("doc_id", (F.col("k") + 1).cast("int").alias("n")).agg(F.sum("cnt").alias("cnt"))


def _counts(spark, sf_dir):
    enc = P.sentence_patterns(P.eligible(coded_tokens(spark, sf_dir)), MAX_N, by_doc=False)
    return enc, cut_lineage(P.ngram_counts(enc))


def _frequent(spark, sf_dir):
    """Single codes and frequent patterns, with their scores."""
    c = P.frequent_counts(cut_lineage(P.sentence_rows(P.eligible(coded_tokens(spark, sf_dir)))), MAX_N, MIN_FREQ)
    return P.collocation_score(c.where(F.col("cnt") >= MIN_FREQ), P.unigram_probabilities(c), ALPHA)


@query("ngram_counts", f"WITH {SCORED} SELECT CAST(n AS INTEGER) AS n, array_to_string(pattern, '|') AS pattern, cnt, round(p, 6) + 0.0 AS p FROM sc")
def ngram_counts(spark, sf_dir):
    _, c = _counts(spark, sf_dir)
    return c.select(F.col("n").cast("int"), _pstr(F.col("pattern")).alias("pattern"), "cnt", R6(F.col("p")).alias("p"))


@query("collocation_score", f"WITH {SCORED} SELECT CAST(n AS INTEGER) AS n, array_to_string(pattern, '|') AS pattern, keep FROM sc WHERE n > 1")
def collocation_score(spark, sf_dir):
    _, c = _counts(spark, sf_dir)
    s = P.collocation_score(c, P.unigram_probabilities(c), ALPHA)
    return s.where(F.col("n") > 1).select(F.col("n").cast("int"), _pstr(F.col("pattern")).alias("pattern"), "keep")


@query("pattern_subsets", f"""WITH {SCORED},
kept AS (SELECT pattern FROM sc WHERE cnt >= {MIN_FREQ} AND keep AND n >= 2)
SELECT DISTINCT array_to_string(pattern, '|') AS pattern, array_to_string(list_filter(pattern, lambda x, i: ((m >> (i - 1)) & 1) = 1), '|') AS sub
FROM (SELECT pattern, unnest(range(1, (1 << len(pattern)) - 1)) AS m FROM kept)""")
def pattern_subsets(spark, sf_dir):
    """Proper non-empty sub-multisets of each frequent probable pattern."""
    from textmill.operators.setops import pattern_subsets as subsets
    s = _frequent(spark, sf_dir)
    kept = s.where((F.col("cnt") >= MIN_FREQ) & F.col("keep") & (F.col("n") >= 2)).select("pattern")
    return subsets(kept, "pattern", out="sub").select(_pstr(F.col("pattern")).alias("pattern"),
                                                      _pstr(F.col("sub")).alias("sub"))


@query("maximal_patterns", f"WITH {FINAL} SELECT array_to_string(pattern, '|') AS pattern FROM fin")
def maximal_patterns(spark, sf_dir):
    s = _frequent(spark, sf_dir)
    kept = s.where((F.col("cnt") >= MIN_FREQ) & (F.col("n") >= MIN_N) & F.col("keep")).select("pattern")
    return P.maximal_patterns(kept).select(_pstr(F.col("pattern")).alias("pattern"))


@query("compact_pattern_ids", f"WITH {FINAL} SELECT CAST(pid AS BIGINT) AS pid, array_to_string(pattern, '|') AS pattern FROM ids")
def compact_pattern_ids(spark, sf_dir):
    final, _ = _mined(spark, sf_dir)
    return final.select("pid", _pstr(F.col("pattern")).alias("pattern"))


@query("sorted_patterns", f"WITH {FINAL} SELECT CAST(pid AS BIGINT) AS rank, array_to_string(pattern, '|') AS pattern FROM ids")
def sorted_patterns(spark, sf_dir):
    """Final patterns in lexical order of their code arrays."""
    final, _ = _mined(spark, sf_dir)
    return final.orderBy("pattern").select(F.col("pid").alias("rank"), _pstr(F.col("pattern")).alias("pattern"))


@query("mine_collocations", f"WITH {FINAL} SELECT CAST(pid AS BIGINT) AS pid, array_to_string(pattern, '|') AS pattern FROM ids")
def mine_collocations(spark, sf_dir):
    final, _ = _mined(spark, sf_dir)
    return final.select("pid", _pstr(F.col("pattern")).alias("pattern"))


@query("keep_final_patterns", f"""WITH {FINAL}
SELECT enc.doc_id, CAST(ids.pid AS BIGINT) AS pid, count(*) AS n FROM enc JOIN ids USING (pattern) GROUP BY enc.doc_id, ids.pid""")
def keep_final_patterns(spark, sf_dir):
    _, per_doc = _mined(spark, sf_dir)
    return per_doc


@query("doc_pattern_counts", f"""WITH {FINAL}
SELECT enc.doc_id, CAST(ids.pid AS BIGINT) AS pid, count(*) AS n FROM enc JOIN ids USING (pattern) GROUP BY enc.doc_id, ids.pid""")
def doc_pattern_counts(spark, sf_dir):
    """Sparse document x pattern count matrix (long form)."""
    _, per_doc = _mined(spark, sf_dir)
    return per_doc


@query("label_pattern", f"""WITH {FINAL}
SELECT CAST(pid AS BIGINT) AS pid, array_to_string(list_transform(pattern, lambda c: CASE WHEN list_contains({S.lit_list(LABELS)}, c) THEN upper(c) ELSE c END), chr(9)) AS label FROM ids""")
def label_pattern(spark, sf_dir):
    final, _ = _mined(spark, sf_dir)
    return final.select("pid", P.label_pattern(F.col("pattern"), LABELS).alias("label"))


@query("cluster_lemma_counts", f"WITH {MERGED} SELECT canon AS cluster, lemma, count(*) AS n FROM mt WHERE canon IS NOT NULL GROUP BY canon, lemma")
def cluster_lemma_counts(spark, sf_dir):
    return P.cluster_lemma_counts(coded_tokens(spark, sf_dir), "canon")


@query("top3_cluster_names", f"""WITH {MERGED},
c AS (SELECT canon AS cluster, lemma, count(*) AS n FROM mt WHERE canon IS NOT NULL GROUP BY canon, lemma),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, lemma) AS rk FROM c)
SELECT cluster, string_agg(lemma, ',' ORDER BY rk) AS name FROM r WHERE rk <= 3 GROUP BY cluster""")
def top3_cluster_names(spark, sf_dir):
    return P.top3_cluster_names(P.cluster_lemma_counts(coded_tokens(spark, sf_dir), "canon"))


# ---------------------------------------------------------------- pruned (apriori) variant
PRUNED = MERGED + """,
g1 AS (SELECT doc_id, sent_id, [i] AS gram FROM mt),
""" + _enc_sql("g1", "e1") + """,
up AS (SELECT pattern[1] AS code, cnt / (SELECT sum(cnt) FROM (SELECT count(*) AS cnt FROM e1 GROUP BY pattern)) AS p
       FROM (SELECT pattern, count(*) AS cnt FROM e1 GROUP BY pattern)),
""" + _score_sql("e1", "up", "s1") + f""",
k1 AS (SELECT pattern FROM s1 WHERE cnt >= {MIN_FREQ} AND keep),
h1 AS (SELECT doc_id, sent_id, gram FROM e1 WHERE pattern IN (SELECT pattern FROM k1)),
""" + _grow_sql("h1", "g2") + ",\n" + _enc_sql("g2", "e2") + ",\n" + _score_sql("e2", "up", "s2") + f""",
k2 AS (SELECT pattern FROM s2 WHERE cnt >= {MIN_FREQ} AND keep),
h2 AS (SELECT doc_id, sent_id, gram FROM e2 WHERE pattern IN (SELECT pattern FROM k2)),
""" + _grow_sql("h2", "g3") + ",\n" + _enc_sql("g3", "e3") + ",\n" + _score_sql("e3", "up", "s3") + f""",
k3 AS (SELECT pattern FROM s3 WHERE cnt >= {MIN_FREQ} AND keep),
h3 AS (SELECT doc_id, sent_id, gram FROM e3 WHERE pattern IN (SELECT pattern FROM k3)),
""" + _grow_sql("h3", "g4") + ",\n" + _enc_sql("g4", "e4") + ",\n" + _score_sql("e4", "up", "s4") + f""",
k4 AS (SELECT pattern FROM s4 WHERE cnt >= {MIN_FREQ} AND keep),
enc AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4),
kept AS (SELECT pattern FROM k1 UNION SELECT pattern FROM k2 UNION SELECT pattern FROM k3 UNION SELECT pattern FROM k4),
""" + _final_sql("kept")


@query("mine_collocations_pruned", f"WITH {PRUNED} SELECT CAST(pid AS BIGINT) AS pid, array_to_string(pattern, '|') AS pattern FROM ids")
def mine_collocations_pruned(spark, sf_dir):
    final, _ = P.mine_collocations_pruned(coded_tokens(spark, sf_dir), MIN_N, MAX_N, ALPHA, MIN_FREQ)
    return final.select("pid", _pstr(F.col("pattern")).alias("pattern"))
