"""Hand fixtures and properties for windows, vectors, patterns, joins and
sinks."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textmill.operators import joins as J
from textmill.operators import patterns as P
from textmill.operators import vectors as V
from textmill.operators import windows as WN
from textmill.functions.hashing import phash


def test_group_row_number_matches_window(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("h", phash("id"))
    got = WN.group_row_number(df, ["g"], ["h", "id"]).select("id", "rn")
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")).alias("rn2"))
    assert got.join(want, "id").where("rn != rn2").count() == 0


def test_compact_ids_consecutive(spark):
    df = spark.range(0, 300).select((F.col("id") * 7 % 1000).cast("string").alias("k"))
    ids = sorted(r.pid for r in WN.compact_ids(df, ["k"], "pid").collect())
    assert ids == list(range(300))


def test_stratified_folds_balanced(spark):
    df = spark.range(0, 101).select("id", (F.col("id") % 4).alias("label"))
    f = WN.stratified_folds(df, "label", 3)
    sizes = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in sizes)
    assert f.count() == 101


def test_skipgrams_fixture(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "doc_id long, arr array<string>")
    pairs = V.skipgram_pairs(docs, 1, mode="expected")
    got = sorted((r.word, r.context) for r in pairs.collect())
    assert got == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def test_ppmi_hand_example(spark):
    counts = spark.createDataFrame([("x", "x", 2.0), ("x", "y", 1.0), ("y", "x", 1.0)],
                                   "word string, context string, n double")
    got = {(r.word, r.context): r.ppmi for r in V.ppmi(counts, 0.75).collect()}
    D = 4.0
    nc = {"x": 3.0, "y": 1.0}
    A = sum(v ** 0.75 for v in nc.values())
    nw = {"x": 3.0, "y": 1.0}
    for (w, c), n in [(("x", "x"), 2.0), (("x", "y"), 1.0), (("y", "x"), 1.0)]:
        want = max(0.0, np.log2((n / D) / ((nw[w] / D) * (nc[c] ** 0.75 / A))))
        assert got[(w, c)] == pytest.approx(want)


def test_weighted_mean_oov_is_zero(spark):
    docs = spark.createDataFrame([(1, ["a", "zz"]), (2, ["zz"])], "id long, tokens array<string>")
    vecs = spark.createDataFrame([("a", [1.0, 2.0])], "token string, vec array<double>")
    w = spark.createDataFrame([("a", 0.5)], "token string, w double")
    got = {r.id: r.vec for r in V.weighted_vectors(docs, vecs, w).collect()}
    assert got[1] == [0.5, 1.0]
    assert got[2] == [0.0, 0.0]


def test_remove_component_zero_projection(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    out = np.array([r.vec for r in V.remove_component(df, "vec", 1).orderBy("id").collect()])
    X = np.array([r[1] for r in rows])
    v = np.linalg.svd(X, full_matrices=False)[2][0]
    assert np.allclose(out @ v, 0, atol=1e-8)


def _tree(spark):
    # sentence of 4 tokens; 1 and 2 both attach to 0, 3 attaches to 2
    rows = [(1, 0, 0, "a", "a", None, "A"), (1, 0, 1, "b", "b", 0, "B"),
            (1, 0, 2, "c", "c", 0, "C"), (1, 0, 3, "d", "d", 2, "D")]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, i int, form string, lemma string, head int, code string")


def test_connected_pairs_include_non_adjacent(spark):
    tok = _tree(spark)
    g2 = P.grow_connected_ngrams(P.unigrams(tok), tok)
    got = sorted(tuple(r.gram) for r in g2.collect())
    assert got == [(0, 1), (0, 2), (2, 3)]
    g3 = P.grow_connected_ngrams(g2, tok)
    assert sorted(tuple(r.gram) for r in g3.collect()) == [(0, 1, 2), (0, 2, 3)]


def test_pruned_equals_plain_without_filters(spark):
    tok = _tree(spark).withColumn("canon", F.lit(None).cast("string"))
    a, _ = P.mine_collocations(tok, 1, 3, 0.0, 1)
    b, _ = P.mine_collocations_pruned(tok, 1, 3, 0.0, 1)
    pa = sorted(tuple(r.pattern) for r in a.collect())
    pb = sorted(tuple(r.pattern) for r in b.collect())
    assert pa == pb == [("A", "B", "C"), ("A", "C", "D")]


def test_match_phrases_longest_then_earliest(spark):
    rows = [(1, 0, i, w, w, None) for i, w in enumerate(["of", "the", "the", "cat"])]
    tok = spark.createDataFrame(rows, "doc_id long, sent_id int, i int, form string, lemma string, head int")
    ph = spark.createDataFrame([("of the", "F"), ("the the", "G"), ("the", "A")], "phrase string, label string")
    got = sorted((r.start, r.len, r.label) for r in P.match_phrases(tok, ph).collect())
    assert got == [(0, 2, "F"), (2, 1, "A")]


def test_left_join_keeps_key(spark):
    base = spark.createDataFrame([(1,), (2,)], "id long")
    long = spark.createDataFrame([(1, "f", 3.0)], "id long, name string, value double")
    got = {r.id: r.f for r in J.join_features(base, long, ["f"]).collect()}
    assert got == {1: 3.0, 2: None}


def test_pattern_subsets(spark):
    from textmill.operators.setops import pattern_subsets
    df = spark.createDataFrame([(["a", "a", "b"],)], "pattern array<string>")
    subs = sorted(tuple(r.sub) for r in pattern_subsets(df, "pattern").collect())
    assert subs == [("a",), ("a", "a"), ("a", "b"), ("b",)]


def test_word_vectors_of_a_flat_spectrum(spark):
    """Singular values of a matrix whose spectrum hardly falls are exact."""
    rng = np.random.default_rng(2)
    n, k = 120, 10
    X = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3)
    cells = spark.createDataFrame([(f"t{i}", f"t{j}", float(X[i, j])) for i, j in zip(*X.nonzero())], "word string, context string, ppmi double")
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(n)], "token string, tok_id long")
    got = np.array([r.vec for r in V.svd_word_vectors(cells, vocab, k).orderBy("tok_id").collect()])
    u, s, vt = np.linalg.svd(X)
    assert np.allclose((got ** 2).sum(axis=0), s[:k], rtol=1e-6)
    assert np.allclose(got @ got.T, u[:, :k] @ np.diag(s[:k]) @ u[:, :k].T, atol=1e-5)


def test_null_strata_are_kept(spark):
    from textmill.operators import windows as W
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, y string")
    assert sorted(r.id for r in W.stratified_folds(df, "y", 2).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in W.stratified_split(df, "y").collect()) == [1, 2, 3, 4, 5]


def test_sentence_patterns_match_joined_growth(spark):
    """Trees, self-headed roots, rings of heads, missing and null heads."""
    heads = {0: [0, 0, 1, 1, 3, 3, 0], 1: [1, 2, 0, 0, 3], 2: [1, 0, 1], 3: [9, None, 1, 2], 4: [3, 0, 1, 2, 0]}
    rows = [(7, s, i, h, "abc"[i % 3]) for s, hs in heads.items() for i, h in enumerate(hs)]
    tok = spark.createDataFrame(rows, "doc_id long, sent_id long, i long, head long, code string")
    want, g = {}, P.unigrams(tok)
    for n in range(1, 5):
        for r in g.collect():
            want[tuple(r.pattern)] = want.get(tuple(r.pattern), 0) + 1
        g = P.grow_connected_ngrams(g, tok)
    got = {}
    for r in P.sentence_patterns(tok, 4).collect():
        got[tuple(r.pattern)] = got.get(tuple(r.pattern), 0) + r.cnt
    assert got == want


def test_connected_sets_lists_each_set_once():
    sets = [frozenset(m) for m in P.connected_sets({0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 4}, 4)]
    assert len(sets) == len(set(sets))


def test_asked_filter_needs_its_column(spark):
    tok = spark.createDataFrame([(1, 0, 0, 0, "a", "DET", True), (1, 0, 1, 0, "b", None, None)], "doc_id long, sent_id long, i long, head long, code string, pos string, is_stop boolean")
    assert [r.code for r in P.eligible(tok, ["DET"], True).collect()] == ["b"]
    with pytest.raises(ValueError):
        P.eligible(tok.drop("pos"), ["DET"])


@pytest.mark.parametrize("block_words", [20_000, 3])
def test_nearest_items_match_brute_force(spark, monkeypatch, block_words):
    from textmill.operators import nearest as NR

    monkeypatch.setattr(NR, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(NR, "CELLS", 4)
    r = np.random.default_rng(3)
    vec = {w: r.normal(size=5) for w in "abcdefgh"}
    docs = {1: list("aabc"), 2: list("h"), 3: ["x"], 4: list("efgab"), 5: list("ab")}
    items = {10: list("abc"), 11: list("hg"), 12: ["x"], 13: list("deeef"), 14: list("cba")}
    vecs = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "token string, vec array<double>")
    sides = [*(spark.createDataFrame(list(x.items()), f"{k} long, tokens array<string>") for x, k in ((docs, "doc_id"), (items, "item_id"))), vecs]

    def one_way(a, b):
        a, b = ([w for w in x if w in vec] for x in (a, b))
        return np.mean([min(np.linalg.norm(vec[x] - vec[y]) for y in b) for x in a])

    want = {(d, i): max(one_way(a, b), one_way(b, a)) for d, a in docs.items() for i, b in items.items() if d != 3 and i != 12}
    got = {(x.doc_id, x.item_id): x.rwmd for x in NR.relaxed_wmd(*sides).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    best = {x.doc_id: x.item_id for x in NR.nearest_items(*sides).collect()}
    assert best == {d: min((round(want[d, i], 9), i) for i in items if i != 12)[1] for d in docs if d != 3}


def test_nearest_item_skips_items_that_cannot_win():
    """The second bound is worked out for few of the items, and never for one too few."""
    from textmill.operators import nearest as NR
    r = np.random.default_rng(4)
    vecs = r.normal(size=(300, 8))
    bags = [np.sort(r.choice(300, 12, replace=False)) for _ in range(400)]
    items = NR.Items(list(range(400)), np.arange(0, 4800, 12), np.full(4800, 1 / 12), np.concatenate(bags), vecs)
    docs = [(np.sort(np.unique(np.r_[b[:9], r.choice(300, 3)])), None) for b in bags[:50]]
    docs = [(word, np.full(len(word), 1 / len(word))) for word, _ in docs]
    least, back = NR.prefetched(vecs, items, docs)
    tried = 0
    for k, (word, weight) in enumerate(docs):
        own = np.maximum(weight @ least[word], np.add.reduceat(items.weights * back[k][items.words], items.starts))
        item, value, n = NR.nearest_of(word, weight, vecs, least, items)
        assert (item, value) == (int(np.argmin(np.round(own, 9))), float(np.round(own.min(), 9)))
        tried += n
    assert tried < 0.1 * 50 * 400


def test_counts_and_positions_inside_the_row(spark):
    from textmill.functions import arrays as A
    rows = {1: list("abacb"), 2: [], 3: None, 4: ["x"]}
    df = spark.createDataFrame(list(rows.items()), "id long, tokens array<string>")
    got = sorted((r.id, r.token, r.n) for r in A.explode_counts(df, "id", "tokens").collect())
    assert got == [(1, "a", 2), (1, "b", 2), (1, "c", 1), (4, "x", 1)]
    at = {r.id: {x.value: x.at for x in r.p or []} for r in df.select("id", A.value_positions("tokens").alias("p")).collect()}
    assert at == {1: {"a": [0, 2], "b": [1, 4], "c": [3]}, 2: {}, 3: {}, 4: {"x": [0]}}
    vocab = spark.createDataFrame([("a",), ("b",)], "token string")
    kept = {r.id: r.kept for r in J.filter_in_vocab(df, "tokens", vocab, max_len=3).collect()}
    assert kept == {1: ["a", "b", "a"], 2: [], 3: [], 4: []}


def test_feature_subsets_of_long_lists(spark):
    from textmill.operators.setops import feature_subsets
    names = spark.createDataFrame([(f"f{i:02d}",) for i in range(40)], "name string")
    got = feature_subsets(names, "name", min_size_from_top=2).collect()
    assert len(got) == len({r.mask for r in got}) == 1 + 40 + 40 * 39 // 2
    assert all(r.size == len(r.members.split(",")) for r in got)


@pytest.mark.parametrize("block", [1, 200_000])
def test_phrases_of_any_length(spark, monkeypatch, block):
    from textmill.operators import patterns as P
    monkeypatch.setattr(P, "PHRASE_BLOCK", block)
    rng = random.Random(6)
    phrases = sorted({" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6) for _ in range(3)} - {"a", "b", "c"}) + ["in FRONT of", "of"]
    sentences = [[rng.choice(["a", "B", "c", "in", "front", "of"]) for _ in range(rng.randrange(14))] for _ in range(80)] + ["stand in front of it".split()]
    tokens = spark.createDataFrame([(1, k, i, w) for k, s in enumerate(sentences) for i, w in enumerate(s)], "doc_id long, sent_id int, i int, form string")
    got = {tuple(r) for r in P.match_phrases(tokens, spark.createDataFrame([(p, p.upper()) for p in phrases], "phrase string, label string")).collect()}
    want = set()
    for k, s in enumerate(sentences):
        low, taken = [w.lower() for w in s], set()
        spans = sorted((-len(p.split()), i, p.upper()) for p in phrases for i in range(len(s)) if low[i:i + len(p.split())] == p.lower().split())
        for n, i, label in spans:
            if not taken & set(range(i, i - n)):
                taken |= set(range(i, i - n))
                want.add((1, k, i, -n, label))
    assert got == want and (1, len(sentences) - 1, 1, 3, "IN FRONT OF") in got
