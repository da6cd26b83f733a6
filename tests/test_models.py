"""Models, selectors and searches on small made-to-measure rows."""

import inspect

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from textmill.functions.text import char_ngrams
from textmill.operators import models as MD
from textmill.operators import selection as SL


@pytest.fixture(scope="module")
def rows(spark):
    """a decides the label, b follows a, c and d say nothing."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(120):
        y = i % 2
        a = float(y * 3 + rng.integers(0, 2))
        data.append((i, a, a + float(rng.normal(0, 0.01)), float(rng.integers(0, 5)), float(rng.integers(0, 5)), float(y), i // 2 % 3))
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, label double, fold int").cache()


def test_subset_search_scores_every_subset(rows):
    train, held = rows.where("id >= 30"), rows.where("id < 30")
    got = MD.subset_search(train, held, ["a", "c", "d"], min_size=2, n_trees=3, max_depth=3).collect()
    assert {r.subset for r in got} == {"a,c,d", "a,c", "a,d", "c,d"}
    best = {r.subset: (r.validation, r.crossvalidation) for r in got}
    assert best["a,c"] == (1.0, 1.0) and max(best["c,d"]) < 1.0
    assert [r.validation for r in got] == sorted((r.validation for r in got), reverse=True)


def test_naive_bayes_selector_matches_numpy(spark):
    X = np.array([[3, 0, 1, 9], [1, 0, 2, 8], [0, 1, 0, 7], [0, 0, 3, 9]], float)
    y = [0, 0, 1, 1]
    df = spark.createDataFrame([(x.tolist(), float(v)) for x, v in zip(X, y)], "x array<double>, label double").select(
        array_to_vector("x").alias("counts"), "label")
    score = np.zeros(4)
    for c in (0, 1):
        o = X[np.array(y) == c].sum(axis=0)
        score += np.abs(np.log((o + 1) / (o.sum() + 4)))
    for t, limit in (("mean", score.mean()), ("median", np.median(score)), (4.0, 4.0)):
        assert list(MD.NaiveBayesSelector(threshold=t).fit(df).getIndices()) == [i for i in range(4) if score[i] >= limit]
    with pytest.raises(ValueError):
        MD.NaiveBayesSelector(threshold=1e6).fit(df)


def test_vocabulary_has_no_bound(spark):
    n = 2 ** 18 + 10  # over Spark's default
    df = spark.range(n // 10 + 1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat_ws("-", "id", k)).alias("grams"))
    model = MD.text_pipeline_stages(min_df=0.0, max_df=1.0)[0].fit(df)
    assert len(model.vocabulary) == df.count() * 10


def test_selector_inside_a_pipeline_saves(spark, tmp_path):
    texts = ["aaa bbb", "aaa ccc", "ddd bbb", "ddd eee"] * 3
    df = MD.add_char_ngrams(spark.createDataFrame([(i, t, float(i % 4 > 1)) for i, t in enumerate(texts)], "id long, text string, label double"))
    pipe = Pipeline(stages=MD.text_pipeline_stages(min_df=0.0, max_df=1.0, select="median") + [MD.fit_nb()])
    model = pipe.fit(df)
    model.write().save(f"{tmp_path}/m")
    again = type(model).load(f"{tmp_path}/m")
    a, b = ([r.prediction for r in m.transform(df).orderBy("id").collect()] for m in (model, again))
    assert a == b == [float(i % 4 > 1) for i in range(12)]
    assert model.stages[1].getIndices() and len(model.stages[1].getIndices()) < len(model.stages[0].vocabulary)


def test_cv_predict_gives_each_row_once(rows):
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "c"], outputCol="features"), MD.fit_lr(1.0, 80)])
    got = MD.cv_predict(pipe, rows).collect()
    assert sorted(r.id for r in got) == list(range(120))
    assert all(r.label == r.prediction for r in got)


def test_successive_halving_and_random_search(rows):
    lr = MD.fit_lr(max_iter=5)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1, 1.0]).build()
    got = MD.successive_halving(pipe, grid, rows, min_fraction=0.34).collect()
    assert [r.candidate for r in got if r["round"] == 0] == [0, 1, 2]
    assert len([r for r in got if r["round"] == 1]) == 1
    assert len(MD.random_search(pipe, grid, rows, n_iter=2).getEstimatorParamMaps()) == 2


def test_search_over_five_folds(rows):
    lr = MD.fit_lr(max_iter=5)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), lr])
    cv = MD.random_search(pipe, ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build(), rows.withColumn("fold", (F.col("id") % 5).cast("int")))
    assert cv.getNumFolds() == 5 and len(cv.avgMetrics) == 2


def test_searches_have_the_reference_grids():
    forest = MD.BalancedForest()
    grid = MD.forest_grid(forest)
    assert len(grid) == 864 and {m[forest.numTrees] for m in grid} == {50, 100, 200}
    assert inspect.signature(MD.random_search).parameters["n_iter"].default == 100
    pipe, grid = MD.halving_search(["a", "b"])
    assert len(grid) == 192 and len({str(sorted((p.name, v) for p, v in m.items())) for m in grid}) == 192
    assert pipe.getStages()[-1].getNumTrees() == 100


def test_balanced_forest_splits_large_nodes_only(rows):
    data = VectorAssembler(inputCols=["a", "c", "d"], outputCol="features").transform(
        rows.withColumn("label", F.when(F.col("id") % 7 == 0, 1.0 - F.col("label")).otherwise(F.col("label"))))

    def sizes(node):
        if node.subtreeDepth() == 0:
            return []
        return [node.impurityStats().rawCount(), *sizes(node.leftChild()), *sizes(node.rightChild())]

    found = {}
    for least in (2, 30):
        forest = MD.BalancedForest()
        model = Pipeline(stages=[forest]).fit(data, {forest.minInstancesSplit: least, forest.numTrees: 5, forest.maxDepth: 6}).stages[0]
        assert model.getNumTrees == 5 and model.transform(data).where("prediction = label").count() > 80
        found[least] = [sizes(t.rootNode()) for t in model._java_obj.trees()]
    assert min(min(f) for f in found[2]) < 30
    assert [[n for n in f if n >= 30] for f in found[2]] == found[30]  # children are smaller than their node


def test_halving_search_runs_on_texts(spark):
    texts = ["aaa bbb", "aaa ccc", "ddd bbb", "ddd eee"] * 6
    df = spark.createDataFrame([(i, t, float(i % 4 > 1), i // 4 % 3) for i, t in enumerate(texts)], "id long, text string, label double, fold int")
    df = df.withColumns({f"g{lo}": F.array_distinct(char_ngrams(F.col("text"), lo, hi)) for lo, hi in ((2, 5), (3, 4))})
    pipe, grid = MD.halving_search(["g2", "g3"])
    pipe.getStages()[-1].setNumTrees(3)
    some = [m for m in grid if m[pipe.getStages()[-1].maxDepth] == 5 and m[pipe.getStages()[-1].minInstancesPerNode] == 1][::9]
    got = MD.successive_halving(pipe, [{p: v for p, v in m.items() if p.name != "numTrees"} for m in some], df, min_fraction=0.9).collect()
    assert [sum(r["round"] == k for r in got) for k in (0, 1)] == [len(some), -(-len(some) // 3)]


def test_selectors_find_the_telling_column(rows):
    tree = {r.name: r.selected for r in SL.select_by_tree_importance(rows, ["a", "c", "d"], "label").collect()}
    assert tree == {"a": True, "c": False, "d": False}
    l1 = {r.name: r.selected for r in SL.select_by_l1(rows, ["a", "c", "d"], "label", reg=0.1).collect()}
    assert l1 == {"a": True, "c": False, "d": False}
    vif = {r.name: r for r in SL.vif_filter(rows, ["a", "b", "c"]).collect()}
    X = np.array(rows.select("a", "b", "c").collect())
    want = np.diag(np.linalg.inv(np.corrcoef(X.T)))
    assert np.allclose([vif[c].vif for c in "abc"], want, rtol=1e-4)
    assert vif["a"].kept + vif["b"].kept == 1 and vif["c"].kept


def test_depth_over_the_limit_is_an_error():
    with pytest.raises(ValueError):
        MD.fit_rf(max_depth=MD.MAX_TREE_DEPTH + 1)
