"""What may not grow: rows that are held, n-grams that are written, fits that wait."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from textmill.operators import joins as J
from textmill.operators import models as MD
from textmill.operators import patterns as P
from textmill.operators import search as SR
from textmill.operators import vectors as V
from textmill.plans import q_patterns

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = ["Abcabc  abc", "", "ab", "é中abc\n\n abc", "abcabcabc", "bcd bcd", "xyz" * 40, "abc bcd"]
    return MD.add_char_ngrams(spark.createDataFrame([(i, t, float(i % 2), i % 3) for i, t in enumerate(rows * 4)], "id long, text string, label double, fold int"))


@pytest.mark.parametrize("bounds", [(0.1, 0.5), (2.0, MD.NO_MAX_DF), (0.0, 0.9), (0.2, 20.0)])
@pytest.mark.parametrize("source", [("text", 3, 4), None])
def test_vocabulary_as_by_spark_without_held_rows(spark, texts, monkeypatch, bounds, source):
    kw = dict(inputCol="grams", outputCol="counts", minDF=bounds[0], maxDF=bounds[1], vocabSize=MD.ALL_TERMS)
    want, own = CountVectorizer(**kw).fit(texts), MD.GramVectorizer(**kw)
    own.made_of = source
    # Spark's own fit, which persists the terms of all rows, is not called
    monkeypatch.setattr(CountVectorizer, "_fit_java", lambda *a: pytest.fail("held"))
    got = own.fit(texts)
    assert sorted(got.vocabulary) == sorted(want.vocabulary)
    total = lambda m: {m.vocabulary[i]: n for v in m.transform(texts).select("counts").collect() for i, n in zip(v[0].indices, v[0].values)}
    assert total(got) == total(want)


def test_least_common_terms_are_left_out_first(texts):
    own = MD.GramVectorizer(inputCol="grams", outputCol="counts", vocabSize=2)
    n = {r.g: r["count"] for r in texts.select(F.explode("grams").alias("g")).groupBy("g").count().collect()}
    got = own.fit(texts).vocabulary
    assert len(got) == 2 and min(n[t] for t in got) >= max(v for k, v in n.items() if k not in got)


def test_stored_rows_have_what_is_read(spark, texts, monkeypatch):
    written, plain = [], MD.cut_lineage
    for module in (MD, SR):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(set(df.columns)) or plain(df))
    pipe = Pipeline(stages=MD.text_pipeline_stages(min_df=0.0, max_df=1.0, scale=True) + [MD.fit_nb()])
    MD.fit_stages(pipe, texts)
    MD.grid_search(pipe, [{}], texts, metric="accuracy", refit=False)
    assert len(written) == 7 and all(w == {"counts", "label"} for w in written)


@pytest.fixture(scope="module")
def coded(spark):
    import random
    rng = random.Random(4)
    rows = [(d, s, i, rng.choice([None, *range(-1, 9)]), rng.choice("abcdefgh") + rng.choice("xyz"))
            for d in range(30) for s in range(4) for i in range(rng.randrange(9))]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, i int, head int, code string")


def test_ngrams_grow_in_their_sentences(spark, coded):
    """As by joins, rings of heads included, without a shuffle or a table."""
    sents = coded.groupBy("doc_id", "sent_id").agg(F.collect_list(F.struct("i", "head", "code")).alias("t")).localCheckpoint()
    rows, own = P.unigrams(coded), P.unigrams(sents)
    for n in range(2, 5):
        rows, own = P.grow_connected_ngrams(rows, coded).localCheckpoint(), P.grow_connected_ngrams(own)
        got = sorted((r.doc_id, r.sent_id, tuple(r.g)) for r in own.select("doc_id", "sent_id", F.explode("grams").alias("g")).collect())
        assert got == sorted((r.doc_id, r.sent_id, tuple(r.gram)) for r in rows.collect()) and got
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert q_patterns.grow_connected_ngrams(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def docs(spark):
    import random
    rng = random.Random(5)
    words = [None, [], ["a"], ["zz"] * 3, *[rng.choices(["a", "b", "c", "d", "é中", "zz", "yy"], k=rng.randrange(1, 30)) for _ in range(40)]]
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, tokens array<string>").repartition(3).localCheckpoint()


@pytest.mark.parametrize("max_len", [None, 4])
def test_words_are_looked_up_in_their_rows(spark, docs, monkeypatch, max_len):
    vocab = spark.createDataFrame([("a",), ("b",), ("é中",), ("d",), ("never",)], "token string")
    got = J.filter_in_vocab(docs, "tokens", vocab, max_len, key="doc_id")
    want = J.joined_in_vocab(docs, "tokens", vocab, max_len, key="doc_id")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "")
    monkeypatch.setattr(J, "HELD_WORDS", 4)
    assert rows(J.filter_in_vocab(docs, "tokens", vocab, max_len, key="doc_id")) == rows(want)
    assert all(r.kept == [] for r in J.filter_in_vocab(docs, "tokens", vocab.limit(0), key="doc_id").collect())


@pytest.mark.parametrize("mode", ["hash", "expected"])
@pytest.mark.parametrize("words", [1, 20, 1_000_000])
def test_pairs_are_counted_without_rows(docs, monkeypatch, mode, words):
    monkeypatch.setattr(V, "PAIR_WORDS", words)
    arrays = docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("arr"))
    want = V.skipgram_counts(V.skipgram_pairs(arrays, 3, mode=mode))
    got = V.skipgram_counts(V.skipgram_pairs(arrays, 3, mode=mode, rows=False))
    own = lambda df: {(r.word, r.context): round(r.n, 9) for r in df.collect()}
    assert own(got) == own(want) and got.columns == want.columns
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_means_by_blocks_of_documents(spark, docs, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_DOCS", block)
    monkeypatch.setattr(V, "ADDED_WORDS", 5)
    vec = {"a": [1.0, 2.0], "b": [0.5, -1.0], "é中": [0.0, 3.0], "d": [1.0, 1.0]}
    w = {"a": 0.5, "b": 0.25, "d": 2.0, "zz": 9.0}
    got = V.weighted_vectors(docs, spark.createDataFrame(list(vec.items()), "token string, vec array<double>"),
                             spark.createDataFrame(list(w.items()), "token string, w double"), 5, key="doc_id")
    want = {}
    for r in docs.collect():
        kept = [t for t in r.tokens or [] if t in vec][:5]
        want[r.doc_id] = [sum(w.get(t, 1e-6) * vec[t][k] for t in kept) / max(len(kept), 1) for k in range(2)]
    assert {r.doc_id: r.vec for r in got.collect()} == {k: pytest.approx(x) for k, x in want.items()}


def test_factors_are_written_by_blocks(spark, monkeypatch):
    """The driver makes no row of its own for each word."""
    import itertools
    monkeypatch.setattr(V, "FACTOR_ROWS", 3)
    seen, plain = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: seen.append(len(data) if hasattr(data, "__len__") else 0) or plain(self, data, *a, **k))
    words = "abcdefgh"
    m = plain(spark, [(a, b, float((3 * i + 5 * j) % 7 + 1)) for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2)], "word string, context string, ppmi double")
    vocab = plain(spark, [(w, i) for i, w in enumerate(words)], "token string, tok_id long")
    vectors, factors = V.svd_factors(m, vocab, 4)
    assert [n for n in seen if n] == [3, 3, 2]
    import numpy as np
    M = np.array([[(3 * i + 5 * j) % 7 + 1.0 for j in range(8)] for i in range(8)])
    x, y = (np.array([r.vec for r in df.orderBy("tok_id").collect()]) for df in (vectors, factors))
    assert np.allclose(M @ y, x)


def test_folds_of_few_rows_are_fitted_at_once(spark, texts, monkeypatch):
    import threading
    gate, plain = threading.Barrier(3, timeout=60), MD.fit_stages
    monkeypatch.setattr(MD, "fit_stages", lambda *a: gate.wait() and None or plain(*a))
    pipe = Pipeline(stages=MD.text_pipeline_stages(min_df=0.0, max_df=1.0) + [MD.fit_nb()])
    together = MD.cv_predict(pipe, texts)
    monkeypatch.setattr(MD, "fit_stages", plain)
    monkeypatch.setattr(MD, "FEW_ROWS", 0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(together) == rows(MD.cv_predict(pipe, texts))


def test_linear_fits_read_few_partitions(spark, texts, monkeypatch):
    seen, plain = [], MD.OneVsRest._fit
    monkeypatch.setattr(MD.OneVsRest, "_fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), self.getParallelism())) or plain(self, df))
    pipe = Pipeline(stages=MD.text_pipeline_stages(min_df=0.0, max_df=1.0, scale=True) + [MD.fit_linear_svm(multiclass=True, max_iter=3)])
    MD.fit_stages(pipe, texts.repartition(8))
    assert seen == [(1, SR.PARALLEL)]


def _joined_pruned(tok, max_n, alpha, min_freq):
    """Round by round with joins of all occurrences."""
    grams, every, pool, one = P.unigrams(tok), None, None, None
    for n in range(1, max_n + 1):
        grams = (grams if n == 1 else P.grow_connected_ngrams(grams, tok)).localCheckpoint()
        every = grams if every is None else every.unionByName(grams)
        counts = P.ngram_counts(grams)
        one = P.unigram_probabilities(counts) if n == 1 else one
        ok = P.collocation_score(counts, one, alpha).where(F.col("keep") & (F.col("cnt") >= min_freq)).select("pattern").localCheckpoint()
        pool = ok if pool is None else pool.unionByName(ok)
        grams = grams.join(ok, "pattern", "left_semi").select("doc_id", "sent_id", "gram", "pattern")
    final = P.compact_pattern_ids(P.maximal_patterns(pool.distinct()))
    return final, P.doc_pattern_counts(P.encode(every), final)


@pytest.mark.parametrize("alpha, min_freq", [(1.2, 4), (0.5, 6), (0.0, 1)])
def test_pruned_rounds_write_no_occurrence(spark, coded, monkeypatch, alpha, min_freq):
    written, plain = [], P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: written.append(set(df.columns)) or plain(df))
    got, want = P.mine_collocations_pruned(coded, 1, 3, alpha, min_freq), _joined_pruned(coded, 3, alpha, min_freq)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(got[0]) == rows(want[0]) and rows(got[1]) == rows(want[1]) and got[0].count() > 5
    assert written and not any("gram" in w for w in written)


def test_fits_hold_few_rows_a_task(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from textmill.operators import extra_trees as ET
    from textmill.operators import windows as WN
    from textmill.sources import files
    monkeypatch.setattr(files, "HELD_ROWS", 50)
    df = spark.range(0, 400, 1, 1).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 3 as double) b", "cast(id % 2 as double) label")
    seen = []
    for kind in (ET.ExtraTrees, MD.RandomForestClassifier):
        monkeypatch.setattr(kind, "_fit", lambda self, rows, plain=kind._fit: seen.append(rows.rdd.getNumPartitions()) or plain(self, rows))
    MD.fit_stages(Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), MD.fit_rf(2, 2)]), df)
    assert seen == [8] and files.spread_rows(df.repartition(9)).rdd.getNumPartitions() == 9
    held, plain = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: held.append(self.rdd.getNumPartitions()) or plain(self, *a))
    ET.ExtraTrees(numTrees=2, maxDepth=2).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    assert held == [8]
    folds = WN.stratified_folds(df, "label", 3)
    assert "SortMergeJoin" not in folds._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.fold): r["count"] for r in folds.groupBy("label", "fold").count().collect()} == {(x, k): n for x in (0.0, 1.0) for k, n in ((0, 67), (1, 67), (2, 66))}
