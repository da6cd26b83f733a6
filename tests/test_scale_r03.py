"""What may not grow: plans that move or hold more than they need."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from textmill.operators import models as MD
from textmill.operators import vectors as V
from textmill.operators import windows as WN
from textmill.plans import q_models, q_vectors

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(df) -> set:
    """Columns of the Parquet files that a frame reads."""
    return {c for f in df.inputFiles() for c in df.sparkSession.read.parquet(f).columns}


def test_ngrams_of_texts_are_not_stored(spark):
    data = q_models._text_data(spark, SF)
    assert _stored(data) == {"id", "text", "label", "fold"} and data.columns[-1] == "grams"


def test_stages_fitted_as_by_the_pipeline(spark):
    texts = ["aaa bbb", "aaa ccc", "ddd bbb", "ddd eee"] * 6
    df = MD.add_char_ngrams(spark.createDataFrame([(i, t, float(i % 4 > 1), i // 4 % 3) for i, t in enumerate(texts)], "id long, text string, label double, fold int"))
    pipe = Pipeline(stages=MD.text_pipeline_stages(min_df=0.0, max_df=1.0, scale=True, select="median") + [MD.fit_nb()])
    a, b = (sorted(tuple(r) for r in m.transform(df).select("id", "prediction").collect()) for m in (pipe.fit(df), MD.fit_stages(pipe, df)))
    assert a == b
    assert _stored(MD.cv_predict(pipe, df)) == {"id", "label", "prediction"}


def test_holdout_ranks_ids_only(spark, monkeypatch):
    seen, plain = [], WN.stratified_split
    monkeypatch.setattr(WN, "stratified_split", lambda df, *a, **k: seen.append(df.columns) or plain(df, *a, **k))
    assert q_models.holdout_report(spark, SF).count() > 0
    assert seen == [["id", "label"]]


def test_fourier_features_of_sparse_rows(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    x = [[0.0, 2.0, 0.0, 1.0], [0.0] * 4, [1.0, -1.0, 3.0, 0.0]]
    df = spark.createDataFrame([(i, Vectors.sparse(4, {k: v for k, v in enumerate(r) if v})) for i, r in enumerate(x)], ["id", "features"])
    got = MD.random_fourier_features(df, "features", "z", 4, n_components=6).select("id", vector_to_array("z").alias("z")).orderBy("id").collect()
    rng = np.random.default_rng(42)
    W, b = rng.normal(0.0, np.sqrt(0.5), size=(4, 6)), rng.uniform(0, 2 * np.pi, size=6)
    assert np.allclose([r.z for r in got], np.sqrt(2 / 6) * np.cos(np.array(x) @ W + b))


def test_pairs_do_not_move_for_their_totals(spark):
    pairs = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "a", 2.0)], "word string, context string, n double")
    for df in (V.ppmi_marginals(pairs), q_vectors.ppmi_marginals(spark, SF)):
        assert "SortMergeJoin" not in _plan(df) and "hashpartitioning" not in _plan(df)
    assert sorted(tuple(r) for r in V.ppmi_marginals(pairs).select("word", "context", "n_w", "n_c").collect()) == [("a", "b", 3.0, 2.0), ("a", "c", 3.0, 1.0), ("b", "a", 2.0, 2.0)]


def test_cells_are_not_expanded_for_their_totals(spark):
    assert "Expand" not in _plan(q_vectors.count_matrix(spark, SF))


def test_word_features_are_written_once(spark):
    assert _stored(q_models._word_features(spark, SF)) == {"id", "name", "value"}


@pytest.fixture(scope="module")
def coded(spark):
    import random
    rng = random.Random(4)
    rows = [(d, s, i, rng.choice([None, *range(-1, 9)]), rng.choice("abcdefgh") + rng.choice("xyz"))
            for d in range(30) for s in range(4) for i in range(rng.randrange(9))]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, i int, head int, code string")


def test_only_what_may_be_frequent_is_counted(spark, coded):
    from textmill.operators import patterns as P
    sents = P.sentence_rows(coded).cache()
    every = {tuple(r.pattern): r.cnt for r in P.sentence_patterns(sents, 4, by_doc=False).groupBy("pattern").agg(F.sum("cnt").alias("cnt")).collect()}
    frequent = {p: n for p, n in every.items() if len(p) == 1 or n >= 4}
    assert {tuple(r.pattern): r.cnt for r in P.frequent_counts(sents, 4, 4).collect()} == frequent
    passed = {tuple(r.pattern) for r in P.sentence_patterns(sents, 4, by_doc=False, only=P.frequent_bits(sents, 4, 4, P.token_sizes(sents))[0]).collect()}
    assert set(frequent) <= passed and len(passed) < len(every) / 2
    whole = P.ngram_counts(P.sentence_patterns(sents, 4))
    p = {tuple(r.pattern): r.p for r in whole.collect()}
    assert all(abs(r.p - p[tuple(r.pattern)]) < 1e-12 for r in P.frequent_counts(sents, 4, 4).collect())
    final, per_doc = P.mine_collocations(coded, 1, 4, 0.5, 4)
    kept = P.collocation_score(whole, P.unigram_probabilities(whole), 0.5).where("keep and cnt >= 4").select("pattern")
    ids = P.compact_pattern_ids(P.maximal_patterns(kept))
    assert sorted(map(tuple, final.select("pid", F.concat_ws("|", "pattern")).collect())) == sorted(map(tuple, ids.select("pid", F.concat_ws("|", "pattern")).collect()))
    assert sorted(map(tuple, per_doc.collect())) == sorted(map(tuple, P.doc_pattern_counts(P.sentence_patterns(sents, 4), ids).collect()))


def test_sentences_are_coded_in_their_rows(spark):
    """As the joined token table, without a shuffle."""
    from textmill.operators import patterns as P
    from textmill.plans import corpus, q_patterns
    tok, ph = corpus.tokens(spark, SF), q_patterns.phrases_df(spark)
    want = P.assign_cluster(P.merge_phrases(tok, P.match_phrases(tok, ph)))
    sents = q_patterns.coded_tokens(spark, SF)
    cols = ["doc_id", "sent_id", "i", "form", "lemma", "head", "canon", "code"]
    got = P.token_rows(sents).select(cols)
    assert got.exceptAll(want.select(cols)).count() == want.select(cols).exceptAll(got).count() == 0 < got.count()
    assert "hashpartitioning" not in _plan(sents)
    assert "hashpartitioning" not in _plan(q_patterns.match_phrases(spark, SF))


@pytest.mark.parametrize("chars", [5, 1_000_000])
def test_ngrams_are_counted_without_arrays(spark, monkeypatch, chars):
    from textmill.functions import arrays as A
    from textmill.functions.text import char_ngrams
    from textmill.operators import counts as C
    monkeypatch.setattr(C, "COUNTED_CHARS", chars)
    texts = ["Abcabc  abc", "", None, "ab", "é中abc\n\n abc", "abcabcabc", "xyz" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    want = A.explode_counts(df, "id", char_ngrams(F.col("text"), 3, 4), "g", "c").groupBy("g").agg(F.sum("c"), F.count("*"))
    got = C.char_ngram_counts(df, "text", 3, 4)
    assert {r.ngram: (r.n, r.cnt, r.n_docs) for r in got.collect()} == {r[0]: (len(r[0]), r[1], r[2]) for r in want.collect()}
    big = spark.createDataFrame([("\U0001F600ab\U0001F600",)], "text string")
    assert {(r.ngram, r.cnt) for r in C.char_ngram_counts(big, "text", 3, 4).collect()} == {("\U0001F600ab", 1), ("ab\U0001F600", 1), ("\U0001F600ab\U0001F600", 1)}
