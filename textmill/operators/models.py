"""Models, search and scoring on Spark ML.

Every fit is a distributed Spark ML job; the driver only loops over a
handful of folds or parameter maps (``parallelism`` runs several fits at
once).  Folds are a column (``stratified_folds``), so every fit sees the
same split and a lost executor recomputes the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassificationModel, RandomForestClassifier,
                                       _ProbabilisticClassifierParams, _RandomForestClassifierParams)
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.hashing import phash
from textmill.functions.text import char_ngrams
from textmill.operators import search as SR
from textmill.operators.counts import char_ngram_counts
from textmill.operators.metrics import f1_binary
from textmill.session import cut_lineage
from textmill.sources.files import spread_rows

MAX_TREE_DEPTH = 30  # Spark's limit
ALL_TERMS = 2 ** 31 - 1  # a vocabulary without a bound
NO_MAX_DF = float(2 ** 63 - 1)  # Spark takes 1.0 as one document


class NaiveBayesSelector(Estimator, HasInputCol, HasOutputCol, HasLabelCol):
    """Pipeline stage that keeps the features whose naive Bayes score, the sum
    over classes of |log p(feature | class)|, is at least ``threshold``
    ("mean", "median" or a number).  Fitted, it is a ``VectorSlicer``."""

    threshold = Param(Params._dummy(), "threshold", "mean, median or a number", TypeConverters.identity)

    def __init__(self, inputCol: str = "counts", outputCol: str = "chosen", labelCol: str = "label", threshold="mean"):
        super().__init__()
        self._setDefault(labelCol="label", threshold="mean")
        self._set(inputCol=inputCol, outputCol=outputCol, labelCol=labelCol, threshold=threshold)

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        nb = NaiveBayes(featuresCol=self.getInputCol(), labelCol=self.getLabelCol()).fit(dataset)
        score = np.abs(nb.theta.toArray()).sum(axis=0)
        t = self.getOrDefault(self.threshold)
        limit = {"mean": np.mean, "median": np.median}[t](score) if isinstance(t, str) else float(t)
        kept = np.flatnonzero(score >= limit - 1e-12 * abs(limit))
        if not len(kept):
            raise ValueError(f"no feature reaches the threshold {limit}")
        return VectorSlicer(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), indices=[int(i) for i in kept])


class GramVectorizer(CountVectorizer):
    """``CountVectorizer`` whose fit holds no rows.  Spark's keeps the terms of
    all rows as objects while it counts those that a share of the rows bounds.
    ``made_of`` (text column, lo, hi) says of which texts the terms are the
    character n-grams: where that column is there, they are counted without
    arrays.  Terms come by their number, then by name.  Fitted, it is a
    ``CountVectorizerModel``."""

    made_of = None

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        if self.made_of and self.made_of[0] in dataset.columns:
            counted = char_ngram_counts(dataset, *self.made_of).select(F.col("ngram").alias("term"), "cnt", "n_docs")
        else:
            terms = self.getInputCol()
            each = dataset.select(F.explode(terms).alias("term"), F.lit(1).alias("cnt"), F.lit(0).alias("n_docs"))
            once = dataset.select(F.explode(F.array_distinct(terms)).alias("term"), F.lit(0).alias("cnt"), F.lit(1).alias("n_docs"))
            counted = each.unionByName(once).groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("n_docs").alias("n_docs"))
        low, high = self.getMinDF(), self.getMaxDF()
        rows = dataset.count() if min(low, high) < 1.0 else 0
        low, high = (x if x >= 1.0 else x * rows for x in (low, high))
        if high < low:
            raise ValueError(f"maxDF {high} is under minDF {low}")
        kept = counted.where((F.col("n_docs") >= low) & (F.col("n_docs") <= high)).orderBy(F.desc("cnt"), "term")
        kept = kept if self.getVocabSize() == ALL_TERMS else kept.limit(self.getVocabSize())
        vocabulary = [r[0] for r in kept.select("term").collect()]
        if not vocabulary:
            raise ValueError("no term is between minDF and maxDF")
        return self._copyValues(CountVectorizerModel.from_vocabulary(vocabulary, self.getInputCol(), self.getOutputCol()))


class BalancedForest(Estimator, _ProbabilisticClassifierParams, _RandomForestClassifierParams):
    """Random forest whose rows weigh rows / (classes x rows of the class), by
    the rows it is fitted on, and whose nodes of fewer than
    ``minInstancesSplit`` rows are leaves.  Spark has no such parameter: as a
    node's split depends on its own rows only, such nodes are cut after the fit.
    Fitted, it is a ``RandomForestClassificationModel``."""

    minInstancesSplit = Param(Params._dummy(), "minInstancesSplit", "least rows of a node that is split", TypeConverters.toInt)

    def __init__(self, seed: int = 42):
        super().__init__()
        self._setDefault(minInstancesSplit=2)
        self._set(seed=seed)

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        label = self.getLabelCol()
        counts = {r[0]: r[1] for r in dataset.groupBy(label).count().collect()}
        weight = F.lit(None).cast("double")
        for value, n in counts.items():
            weight = F.when(F.col(label) == value, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
        rf = self._copyValues(RandomForestClassifier()).setWeightCol("__weight")
        model = rf.fit(dataset.withColumn("__weight", weight))
        least = self.getOrDefault(self.minInstancesSplit)
        # a node that was split has two children of minInstancesPerNode rows at least
        if least > 2 * self.getMinInstancesPerNode():
            model = rf._copyValues(self._cut(model, least))
            model._transfer_params_to_java()
        return model

    @staticmethod
    def _cut(model, least: int) -> RandomForestClassificationModel:
        context = SparkContext._active_spark_context
        ml = context._jvm.org.apache.spark.ml

        def cut(node):
            if node.subtreeDepth() == 0:
                return node
            stats = node.impurityStats()
            if stats.rawCount() < least:
                return ml.tree.LeafNode(node.prediction(), node.impurity(), stats)
            return ml.tree.InternalNode(node.prediction(), node.impurity(), node.gain(), cut(node.leftChild()),
                                        cut(node.rightChild()), node.split(), stats)

        kind, old = ml.classification.DecisionTreeClassificationModel, model._java_obj
        trees = context._gateway.new_array(kind, model.getNumTrees)
        for k, tree in enumerate(old.trees()):
            trees[k] = kind(tree.uid(), cut(tree.rootNode()), model.numFeatures, model.numClasses)
        return RandomForestClassificationModel(
            ml.classification.RandomForestClassificationModel(old.uid(), trees, model.numFeatures, model.numClasses))


def text_pipeline_stages(lo: int = 3, hi: int = 4, min_df: float = 0.1, max_df: float = 0.5,
                         numeric: list[str] | None = None, scale: bool = False, select=None) -> list:
    """Character n-gram counts, chosen by naive Bayes if ``select`` gives a
    threshold (+ pass-through numeric columns) -> features.
    The n-gram array column ``grams`` is made by ``add_char_ngrams`` of ``text``."""
    # a share of 1.0 is no bound
    top = NO_MAX_DF if isinstance(max_df, float) and max_df == 1.0 else max_df
    stages = [GramVectorizer(inputCol="grams", outputCol="counts", minDF=min_df, maxDF=top,
                             vocabSize=ALL_TERMS)]
    stages[0].made_of = ("text", lo, hi)
    if select is not None:
        stages.append(NaiveBayesSelector("counts", "chosen", threshold=select))
    inputs = ["counts" if select is None else "chosen"] + list(numeric or [])
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=False))
    else:
        stages[-1].setOutputCol("features")
    return stages


def add_char_ngrams(df: DataFrame, text: str = "text", lo: int = 3, hi: int = 4) -> DataFrame:
    return df.withColumn("grams", char_ngrams(F.col(text), lo, hi))


def fit_nb(smoothing: float = 1.0):
    return NaiveBayes(modelType="multinomial", smoothing=smoothing)


def fit_rf(n_trees: int = 100, max_depth: int = 10, seed: int = 42):
    if max_depth > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {max_depth} is over Spark's limit of {MAX_TREE_DEPTH}")
    return RandomForestClassifier(numTrees=n_trees, maxDepth=max_depth, seed=seed)


def fit_lr(C: float = 1.0, n_rows: int = 1, penalty: str = "l2", weight_col: str | None = None,
           max_iter: int = 100):
    """regParam = 1 / (C x rows) maps the reference's inverse strength."""
    lr = LogisticRegression(regParam=1.0 / (C * max(n_rows, 1)), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                            maxIter=max_iter)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def fit_linear_svm(C: float = 1.0, n_rows: int = 1, multiclass: bool = False, weight_col: str | None = None,
                   max_iter: int = 100):
    svc = LinearSVC(regParam=1.0 / (C * max(n_rows, 1)), maxIter=max_iter)
    if weight_col:
        svc.setWeightCol(weight_col)
    return OneVsRest(classifier=svc, parallelism=SR.PARALLEL) if multiclass else svc


def random_fourier_features(df: DataFrame, col: str, out: str, dim: int, n_components: int = 200,
                            gamma: float | None = None, seed: int = 42) -> DataFrame:
    """RBF kernel approximation z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma)
    (Rahimi and Recht 2007).  W is generated from the seed inside each
    Python worker (never shipped); of a row only the entries that are not 0
    cross to Python, in Arrow batches."""
    g = gamma if gamma is not None else 1.0 / dim

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rff(at: pd.Series, xs: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        W = rng.normal(0.0, np.sqrt(2 * g), size=(dim, n_components))
        b = rng.uniform(0, 2 * np.pi, size=n_components)
        scale = np.sqrt(2.0 / n_components)
        return pd.Series([scale * np.cos(np.asarray(x, float) @ W[np.asarray(k, int)] + b) for k, x in zip(at, xs)])

    pairs = F.filter(F.transform("__x", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    arr = df.withColumn("__x", vector_to_array(F.col(col))).withColumn("__x", pairs)
    return arr.withColumn(out, array_to_vector(rff(F.col("__x.i"), F.col("__x.x")))).drop("__x")


def fit_kernel_svm(C: float = 1.0, n_rows: int = 1, multiclass: bool = False, max_iter: int = 100):
    """Linear SVM on random Fourier features (apply ``random_fourier_features``)."""
    return fit_linear_svm(C, n_rows, multiclass, max_iter=max_iter)


def fit_stages(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """``pipeline.fit``, but the counts of a vectoriser are written once, with
    the columns that the stages after it read, before these read them several times.
    A linear model at the end, whose passes are short, reads them in few tasks."""
    fitted, stages = [], pipeline.getStages()
    for k, stage in enumerate(stages):
        if k and k + 1 == len(stages) and isinstance(stage, (LinearSVC, LogisticRegression, OneVsRest)):
            df = SR.gathered(stage, df, df.count())
        elif k + 1 == len(stages) and isinstance(stage, RandomForestClassifier):  # it holds a copy of its rows
            df = spread_rows(df)
        fitted.append(stage.fit(df) if isinstance(stage, Estimator) else stage)
        if k + 1 < len(stages):
            df = fitted[-1].transform(df)
            if isinstance(stage, CountVectorizer):
                df = cut_lineage(SR.read_by(stages[k + 1:], df))
    return PipelineModel(fitted)


#: Rows under which the fits of folds, many short jobs, run at once.
FEW_ROWS = 100_000


def cv_predict(pipeline: Pipeline, df: DataFrame, fold_col: str = "fold", key: str = "id", parallelism: int = SR.PARALLEL) -> DataFrame:
    """Out-of-fold predictions: fit on fold != i, predict fold == i.  They are
    written once, as reports read them several times.  Over few rows
    ``parallelism`` folds run at once."""
    from multiprocessing.pool import ThreadPool

    sizes = {r[0]: r[1] for r in df.groupBy(fold_col).count().collect()}

    def predicted(f):
        m = fit_stages(pipeline, df.where(F.col(fold_col) != f))
        return cut_lineage(m.transform(df.where(F.col(fold_col) == f)).select(key, "label", "prediction"))

    with ThreadPool(parallelism if sum(sizes.values()) < FEW_ROWS else 1) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(predicted), sorted(sizes), chunksize=1)
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def forest_grid(forest: BalancedForest) -> list:
    """The reference's 864 maps of its random search."""
    return (ParamGridBuilder().addGrid(forest.numTrees, [50, 100, 200]).addGrid(forest.featureSubsetStrategy, ["auto", "sqrt"])
            .addGrid(forest.maxDepth, [3, 5, 7, 10]).addGrid(forest.minInstancesSplit, [2, 5, 10])
            .addGrid(forest.minInstancesPerNode, [1, 2, 4]).addGrid(forest.bootstrap, [True, False])
            .addGrid(forest.impurity, ["gini", "entropy"]).build())


def halving_search(gram_cols: list[str]) -> tuple[Pipeline, list]:
    """Pipeline and 192 maps of the reference's halving search (binary n-gram
    counts, naive Bayes selector, forests of 100); ``gram_cols`` hold the
    distinct n-grams of each range."""
    counts = GramVectorizer(inputCol=gram_cols[0], outputCol="counts", binary=True)
    chosen = NaiveBayesSelector("counts", "features")
    forest = fit_rf(100)
    grid = (ParamGridBuilder().addGrid(counts.inputCol, gram_cols).addGrid(counts.maxDF, [NO_MAX_DF, 0.5])
            .addGrid(counts.minDF, [0.0, 0.1]).addGrid(counts.vocabSize, [ALL_TERMS, 2000])
            .addGrid(chosen.threshold, ["median", 1e-4, float("-inf")]).addGrid(forest.maxDepth, [5, 7])
            .addGrid(forest.minInstancesPerNode, [1, 50]).build())
    return Pipeline(stages=[counts, chosen, forest]), grid


def grid_search(pipeline: Pipeline, grid: list, df: DataFrame, fold_col: str = "fold",
                parallelism: int = SR.PARALLEL, metric: str = "f1", refit: bool = True) -> SR.Search:
    """Full grid with k-fold CV on the fold column; best model refitted.
    Stages that maps share are fitted once a fold, and forests once for all
    maps that are cuts of one another (see ``search``)."""
    return SR.cross_validate(pipeline, grid, df, fold_col, metric, parallelism, refit)


def random_search(pipeline: Pipeline, grid: list, df: DataFrame, n_iter: int = 100, fold_col: str = "fold",
                  seed: int = 42, parallelism: int = SR.PARALLEL, metric: str = "f1") -> SR.Search:
    """``n_iter`` parameter maps drawn (seeded) from the grid, then CV."""
    return grid_search(pipeline, SR.drawn(grid, n_iter, seed), df, fold_col, parallelism, metric)


def successive_halving(pipeline: Pipeline, grid: list, df: DataFrame, key: str = "id",
                       fold_col: str = "fold", factor: int = 3, min_fraction: float = 0.25,
                       seed: int = 42) -> DataFrame:
    """Candidates cut to the best 1/factor each round while the share of
    rows grows (rows chosen by seeded hash, so rounds are nested)."""
    cands = list(range(len(grid)))
    frac = min_fraction
    h = phash(key, seed=seed) % 1_000_000
    history = []
    rnd = 0
    while True:
        sub = df.where(h < int(frac * 1_000_000))
        cv = grid_search(pipeline, [grid[i] for i in cands], sub, fold_col, refit=False)
        scores = list(cv.avgMetrics)
        history += [(rnd, cands[i], float(s), float(frac)) for i, s in enumerate(scores)]
        if len(cands) <= 1 or frac >= 1.0:
            break
        keep = -(-len(cands) // factor)
        order = sorted(range(len(cands)), key=lambda i: -scores[i])[:keep]
        cands = [cands[i] for i in order]
        frac = min(1.0, frac * factor)
        rnd += 1
    return df.sparkSession.createDataFrame(history, "round int, candidate int, score double, fraction double")


def model_search(candidates: list[tuple[str, Pipeline, list]], df: DataFrame, fold_col: str = "fold",
                 parallelism: int = SR.PARALLEL, metric: str = "f1") -> DataFrame:
    """Leaderboard of several model families, each cross-validated on its grid."""
    rows = []
    for name, pipe, grid in candidates:
        cv = grid_search(pipe, grid, df, fold_col, parallelism, metric, refit=False)
        best = int(np.argmax(cv.avgMetrics))
        rows.append((name, float(cv.avgMetrics[best]), str({p.name: v for p, v in grid[best].items()})))
    lb = df.sparkSession.createDataFrame(rows, "model string, score double, params string")
    return lb.orderBy(F.desc("score"))


def weighted_grids(n_rows: int) -> dict[str, tuple[list, list]]:
    """(last stages, maps) of the reference's linear SVM, logistic regression
    and forest grids (10, 20 and 14 maps), with class weights from the training
    part as an axis.  ``n_rows`` are the rows of a training part, as penalties
    are per row.  Depths over Spark's limit stand for the limit."""
    # The grids' costs and depths.
    costs, depths = [0.01, 0.1, 1, 10, 100], [1, 10, 50, 100, 200, 300, 400]
    out = {}
    for name, model in (("svm", fit_linear_svm(weight_col="weight")), ("lr", fit_lr(weight_col="weight")), ("rf", fit_rf(100).setWeightCol("weight"))):
        weights = SR.ClassWeights()
        grid = ParamGridBuilder().addGrid(weights.balanced, [True, False])
        if name == "rf":
            grid.addGrid(model.maxDepth, [min(d, MAX_TREE_DEPTH) for d in depths])
        else:
            grid.addGrid(model.regParam, [1.0 / (c * max(n_rows, 1)) for c in costs])
        if name == "lr":
            grid.addGrid(model.elasticNetParam, [1.0, 0.0])
        out[name] = ([weights, model], grid.build())
    return out


def stack_predictions(pipeline: Pipeline, train: DataFrame, test: DataFrame, fold_col: str = "fold",
                      key: str = "id") -> DataFrame:
    """Out-of-fold predictions for train rows, full-fit predictions for test
    rows, as one feature (id, name, value)."""
    oof = cv_predict(pipeline, train, fold_col, key).select(key, "prediction")
    full = fit_stages(pipeline, train).transform(test).select(key, "prediction")
    both = oof.unionByName(full)
    return both.select(F.col(key).alias("id"), F.lit("char_prediction").alias("name"),
                       F.col("prediction").cast("double").alias("value"))


def batch_score(model: PipelineModel, df: DataFrame, carry: list[str] = (), key: str = "id") -> DataFrame:
    """(key, prediction) and the columns ``carry`` of every row."""
    return model.transform(df).select(key, "prediction", *carry)


def subset_search(train: DataFrame, validation: DataFrame, features: list[str], label: str = "label",
                  fold_col: str = "fold", key: str = "id", min_size: int = 1, n_trees: int = 50, max_depth: int = 5,
                  positive: float = 1.0, parallelism: int = 4) -> DataFrame:
    """(subset, size, validation, crossvalidation) of every subset of at least
    ``min_size`` features: F1 of the positive class by a forest fitted on
    ``train`` and scored on ``validation``, and by one cross-validated over
    both (out-of-fold predictions pooled).  Each fit is a Spark ML job;
    ``parallelism`` subsets run at once."""
    from itertools import combinations
    from multiprocessing.pool import ThreadPool

    def assembled(df):
        v = VectorAssembler(inputCols=features, outputCol="__all", handleInvalid="keep").transform(df)
        return v.select(key, fold_col, "__all", F.col(label).cast("double").alias("label")).cache()

    train, validation = assembled(train), assembled(validation)
    both = train.unionByName(validation)

    def scored(subset):
        pipe = Pipeline(stages=[VectorSlicer(inputCol="__all", outputCol="features", indices=[features.index(f) for f in subset]),
                                fit_rf(n_trees, max_depth)])
        held = f1_binary(pipe.fit(train).transform(validation), positive).first()[0]
        crossed = f1_binary(cv_predict(pipe, both, fold_col, key, parallelism=1), positive).first()[0]
        return ",".join(subset), len(subset), float(held), float(crossed)

    subsets = [list(c) for k in range(len(features), max(min_size, 1) - 1, -1) for c in combinations(features, k)]
    with ThreadPool(parallelism) as pool:
        rows = pool.map(inheritable_thread_target(both.sparkSession)(scored), subsets)
    train.unpersist()
    validation.unpersist()
    out = both.sparkSession.createDataFrame(rows, "subset string, size int, validation double, crossvalidation double")
    return out.orderBy(F.desc("validation"), "size", "subset")
