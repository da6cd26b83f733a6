"""Whole texts, the method's own strata, and what may not grow with the words, pairs and documents."""

import pytest
from pyspark.sql import functions as F

from textmill.operators import vectors as V
from textmill.operators import windows as WN
from textmill.plans import q_models, q_vectors
from textmill.plans.registry import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Documents 0 and 1 differ after their first 100 words only."""
    root = str(tmp_path_factory.mktemp("long"))
    head = "alpha beta gamma delta " * 30
    texts = [head + "omega alpha " * 40, head + "sigma beta " * 40, "alpha omega sigma " * 9, "", "beta delta gamma " * 12, "unheard"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality long, toxic long").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.mark.parametrize("query", ["document_vectors", "document_vectors_fit_on"])
def test_document_vectors_are_of_whole_texts(spark, long_texts, query):
    got = {r.id: r.vec for r in getattr(q_vectors, query)(spark, long_texts).collect()}
    assert set(got) == set(range(6)) and max(abs(x - y) for x, y in zip(got[0], got[1])) > 1e-6


@pytest.mark.parametrize("numbers", [3, 4_000_000])
def test_blocks_of_vectors_add_up(spark, monkeypatch, numbers):
    monkeypatch.setattr(V, "VECTOR_NUMBERS", numbers)
    monkeypatch.setattr(V, "HELD_TOKENS", 50)
    docs = spark.createDataFrame([(i, [f"w{(i * k) % 7}" for k in range(40 * i)]) for i in range(6)], "id long, tokens array<string>").repartition(2)
    vec = {f"w{i}": [float(i), 1.0] for i in range(6)}
    got = V.weighted_vectors(docs, spark.createDataFrame(list(vec.items()), "token string, vec array<double>"), spark.createDataFrame([("w1", 0.5), ("w3", 2.0)], "token string, w double"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "").replace("Exchange Partitioning", "")
    for r in got.collect():
        kept = [t for k in range(40 * r.id) if (t := f"w{(r.id * k) % 7}") in vec]
        w = {"w1": 0.5, "w3": 2.0}
        assert r.vec == pytest.approx([sum(w.get(t, 1e-6) * vec[t][k] for t in kept) / max(len(kept), 1) for k in range(2)])


def test_means_are_of_whole_texts(spark, long_texts):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{long_texts}/documents.parquet/*.parquet')")
    want = {(r[0], r[1]): r[2] for r in con.execute(ORACLES["weighted_mean_vector"]).fetchall()}
    got = {(r.id, r.dim): r.value for r in q_vectors.weighted_mean_vector(spark, long_texts).collect()}
    assert got == pytest.approx(want) and max(abs(got[0, k] - got[1, k]) for k in range(6)) > 1e-5


def test_holdout_has_the_mix_of_language_and_class(spark, monkeypatch):
    seen, plain = [], WN.stratified_split
    monkeypatch.setattr(WN, "stratified_split", lambda *a, **k: seen.append(plain(*a, **k).localCheckpoint()) or seen[0])
    q_models.holdout_report(spark, SF)
    labels, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "documents"))
    kinds = labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), "lang", "quality", "toxic").join(seen[0], "id")
    sizes = kinds.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("held")).collect()
    assert len(sizes) > 2 and all(r.held == int(0.2 * r.n + 0.5) for r in sizes)


def test_driver_holds_few_rows_of_the_basis(spark, monkeypatch):
    """Blocks of three rows and one column at a time give numpy's singular vectors; ARPACK's driver copies are not made."""
    import numpy as np
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    monkeypatch.setattr(V, "FACTOR_ROWS", 3)
    monkeypatch.setattr(V, "FACTOR_NUMBERS", 40)
    monkeypatch.setattr(IndexedRowMatrix, "computeSVD", lambda *a, **k: pytest.fail("held"))
    n, k, rng = 40, 5, np.random.default_rng(3)
    M = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    M[7] = 0
    cells = spark.createDataFrame([(f"w{i}", f"w{j}", float(M[i, j])) for i in range(n) for j in range(n) if M[i, j]], "word string, context string, ppmi double")
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(n)], "token string, tok_id long")
    x, y = (np.array([r.vec for r in df.orderBy("tok_id").collect()]) for df in V.svd_factors(cells, vocab, k))
    u, s, vt = np.linalg.svd(M)
    sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    assert np.allclose(x, u[:, :k] * s[:k] ** 0.5 * sign, atol=1e-8) and np.allclose(y, vt[:k].T * s[:k] ** -0.5 * sign, atol=1e-8)


def test_lanczos_finds_equal_and_vanishing_values():
    import numpy as np
    for d in ([5.0] * 12 + [1.0] * 28, list(range(40)), [3.0, 2.0] + [0.0] * 38, [1.0] * 40):
        q = np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))[0]
        g = q * np.array(d) @ q.T
        value, basis = V._largest(lambda x: g @ x, 40, 6)
        assert np.allclose(value, sorted(d)[::-1][:6], atol=1e-9)
        v = np.array([basis.get(j) for j in range(6)])
        assert np.allclose(v @ v.T, np.eye(6)) and np.allclose(v @ g, v * value[:, None], atol=1e-7)


@pytest.mark.parametrize("mode", ["hash", "expected"])
@pytest.mark.parametrize("words, of_range", [(1, 1), (40, 50), (1_000_000, 1_000_000)])
def test_pairs_move_as_differences_of_their_keys(spark, monkeypatch, mode, words, of_range):
    import random
    rng = random.Random(6)
    monkeypatch.setattr(V, "PAIR_WORDS", words)
    monkeypatch.setattr(V, "PAIR_RANGE", of_range)
    lists = [[], ["a"], ["é中"] * 4, *[rng.choices(["a", "b", "c", "d", "é中", "zz"], k=rng.randrange(1, 30)) for _ in range(30)]]
    arrays = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, arr array<string>").repartition(3).localCheckpoint()
    vocab = arrays.select(F.explode("arr").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    own = lambda df: {(r.word, r.context): round(r.n, 9) for r in df.collect()}
    got = V.skipgram_counts(V.skipgram_pairs(arrays, 3, mode=mode, rows=False), vocab)
    assert own(got) == own(V.skipgram_counts(V.skipgram_pairs(arrays, 3, mode=mode))) and got.columns == ["word", "context", "n"]
    assert "hashpartitioning(word" not in got._jdf.queryExecution().executedPlan().toString()
    assert not V.skipgram_counts(V.skipgram_pairs(arrays.where("doc_id < 2"), 3, rows=False), vocab).count()


def test_totals_come_to_the_pairs(spark, monkeypatch):
    from textmill.operators import joins as J
    pairs = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "a", 2.0), ("c", "a", 4.0)], "word string, context string, n double")
    want = [("a", "b", 2.0, 3.0, 2.0), ("a", "c", 1.0, 3.0, 1.0), ("b", "a", 2.0, 2.0, 6.0), ("c", "a", 4.0, 4.0, 6.0)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (V.ppmi_marginals(pairs), V.ppmi(pairs), V.most_similar(V.ppmi(pairs), "a")):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, V.ppmi_marginals(pairs).collect())) == want
        monkeypatch.setattr(J, "LOOKED_UP", 1)
        assert sorted(map(tuple, V.ppmi_marginals(pairs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    t = spark.createDataFrame([("b", 7)], "k string, v int")
    got = J.with_looked_up(pairs.union(spark.createDataFrame([(None, "x", 0.0)], pairs.schema)), ("word", t, "k", ["v"]))
    assert sorted((r.word or "", r.v) for r in got.collect() if r.v) == [("b", 7)] and got.count() == 5


def test_least_distances_and_few_tries(monkeypatch):
    import numpy as np
    from textmill.operators import nearest as NR
    rng = np.random.default_rng(5)
    vecs, words = rng.normal(size=(30, 4)), rng.integers(0, 9, 40)
    starts = np.array([0, 4, 5, 17, 18, 25, 26, 30, 33, 36])
    items = NR.Items(list(range(10)), starts, np.full(40, 0.1), words, rng.normal(size=(9, 4)))
    monkeypatch.setattr(NR, "CELLS", 60)
    least, _ = NR.prefetched(vecs, items)
    d = np.linalg.norm(vecs[:, None] - items.vecs[None], axis=2)
    assert np.allclose(least, np.column_stack([d[:, words[items.entries(i)]].min(axis=1) for i in range(10)]))
    # a document that stands on one item needs no other's second bound
    items.vecs[:] = np.arange(9)[:, None] * 100.0
    one = NR.Items(list(range(9)), np.arange(9), np.ones(9), np.arange(9), items.vecs)
    doc = np.array([[200.0] * 4])
    assert NR.nearest_of(np.array([0]), np.array([1.0]), doc, NR.prefetched(doc, one)[0], one) == (2, 0.0, 3)


def test_sets_come_in_the_order_of_their_trees():
    import random
    import numpy as np
    from textmill.operators import patterns as P
    rng = random.Random(8)
    for n in range(1, 14):
        parent = np.array([-1] + [rng.choice([-1, *range(i)]) for i in range(1, n)])
        want = sorted(tuple(sorted(m)) for m in P.connected_sets({i: (int(h) if h >= 0 else None) for i, h in enumerate(parent)}, 5))
        got = [x.tolist() for x in P._forest_sets(parent, 5)]
        assert sorted(tuple(sorted(r)) for x in got for r in x) == want
        for r in (r for x in got for r in x):  # a member's place is that of its head, then its own number
            place = [(r.index(parent[c]), c) for c in r[1:]]
            assert place == sorted(place)


def test_words_of_sentences_are_found_once(spark):
    from textmill.plans import corpus
    assert corpus.sentence_tokens(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
