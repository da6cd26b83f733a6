"""Searches that share fits: prefixes fitted once, cut forests, metrics."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from textmill.operators import models as MD
from textmill.operators import search as SR


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(0, 0.3, 300) > 0).astype(float)
    df = spark.createDataFrame([(k, *map(float, v), float(t), k % 3) for k, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label double, fold int")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).cache()


def counted(model, rows):
    return {(r["label"], r["prediction"]): r["n"] for r in model.transform(rows).groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()}


def test_cuts_of_a_forest_are_forests(rows):
    """Without chance in the trees, a cut forest is the one that is fitted so."""
    def fit(**more):
        forest = MD.BalancedForest()
        return forest.fit(rows, {getattr(forest, k): v for k, v in {"bootstrap": False, "featureSubsetStrategy": "all", **more}.items()})

    big = fit(numTrees=5, maxDepth=8)
    cuts = [(5, 2, 2), (5, 3, 2), (5, 8, 20), (2, 8, 2), (5, 8, 2), (5, 4, 30)]
    got = SR.cut_counts(big, rows, cuts)
    for k, (n, depth, least) in enumerate(cuts):
        assert got[k] == counted(fit(numTrees=n, maxDepth=depth, minInstancesSplit=least), rows), cuts[k]


def test_random_forests_are_read_as_spark_reads_them(rows):
    forest = MD.BalancedForest(seed=3)
    model = forest.fit(rows, {forest.numTrees: 20, forest.maxDepth: 6})
    assert SR.cut_counts(model, rows, [(20, 6, 2)])[0] == counted(model, rows)


def test_shared_stages_are_fitted_once_a_fold(spark, monkeypatch):
    texts = ["aaa bbb", "aaa ccc", "ddd bbb", "ddd eee"] * 9
    df = MD.add_char_ngrams(spark.createDataFrame([(k, t, float(k % 4 > 1), k // 4 % 3) for k, t in enumerate(texts)], "id long, text string, label double, fold int"))
    fits, plain = [], CountVectorizer.fit
    monkeypatch.setattr(CountVectorizer, "fit", lambda self, *a: fits.append(1) or plain(self, *a))
    last, grid = MD.weighted_grids(24)["lr"]
    assert len(grid) == 20 and [len(MD.weighted_grids(24)[k][1]) for k in ("svm", "rf")] == [10, 14]
    cv = MD.grid_search(Pipeline(stages=MD.text_pipeline_stages(min_df=0.0, max_df=1.0) + last), grid[:4], df, metric="accuracy", refit=False)
    assert len(fits) == 3 and len(cv.avgMetrics) == 4 and max(cv.avgMetrics) == 1.0


def test_class_weights_are_those_of_the_fitted_rows(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 2, "label double")
    got = {r["label"]: r["weight"] for r in SR.ClassWeights().fit(df).transform(df).distinct().collect()}
    assert got == {0.0: 8 / 12, 1.0: 2.0}
    assert {r["weight"] for r in SR.ClassWeights(balanced=False).fit(df).transform(df).collect()} == {1.0}


def test_metrics_of_counts():
    counts = {(0.0, 0.0): 5, (0.0, 1.0): 1, (1.0, 0.0): 2, (1.0, 1.0): 2}
    assert SR.metric_of(counts, "accuracy") == 0.7
    assert SR.metric_of(counts, "f1") == pytest.approx(0.6 * (10 / 13) + 0.4 * (4 / 7))
    assert SR.metric_of({}, "f1") == 0.0
