"""Searches over parameter maps that fit shared work once.

The maps of a grid are read as a trie over the pipeline's stages: within a
fold, a stage is fitted once for each distinct choice of its own and earlier
stages' parameters, so a vectoriser that no map changes is fitted once a fold.

Maps of one random forest share its trees: a tree grown to depth 10 and cut
at depth 3 is, in distribution, one grown to depth 3; one whose nodes of fewer
than m rows are cut is one that never split them; the first 50 of 200 trees
are a forest of 50.  Such maps need one fit and one pass over the validation
rows, which counts the predictions of every cut.
"""

from __future__ import annotations

import random
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (LinearSVC, LogisticRegression, OneVsRest, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import CountVectorizer, SQLTransformer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.session import cut_lineage, ensure_checkpoint_dir

#: Fits that run at once, rows that a task walks through a forest at a time,
#: and rows of a task of the last stage's fits (each is many short jobs; a pass
#: of a linear model takes about a microsecond a row).
PARALLEL, ROWS, TASK_ROWS, LINEAR_TASK_ROWS = 6, 500, 1000, 10_000
#: Parameters of a forest that its cuts answer.
CUT_PARAMS = ("numTrees", "maxDepth", "minInstancesSplit")
#: Parameters that name the columns a stage reads.
READ_PARAMS = ("inputCol", "inputCols", "featuresCol", "labelCol", "weightCol")


class ClassWeights(Estimator, HasLabelCol, HasOutputCol):
    """Weights rows / (classes x rows of the class) from the rows that it is
    fitted on, or 1 for all if not ``balanced``.  Fitted, it is a ``SQLTransformer``."""

    balanced = Param(Params._dummy(), "balanced", "weigh classes by their rows", TypeConverters.toBoolean)

    def __init__(self, labelCol: str = "label", outputCol: str = "weight", balanced: bool = True):
        super().__init__()
        self._set(labelCol=labelCol, outputCol=outputCol, balanced=balanced)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        weight = "1.0D"
        if self.getOrDefault(self.balanced):
            counts = {r[0]: r[1] for r in dataset.groupBy(self.getLabelCol()).count().collect()}  # one row a class
            cases = " ".join(f"WHEN {float(k)!r}D THEN {sum(counts.values()) / (len(counts) * n)!r}D" for k, n in counts.items())
            weight = f"CASE CAST(`{self.getLabelCol()}` AS DOUBLE) {cases} END" if cases else weight
        return SQLTransformer(statement=f"SELECT *, {weight} AS `{self.getOutputCol()}` FROM __THIS__")


@dataclass
class Forest:
    """A fitted forest's nodes as arrays, tree after tree: children (a leaf is
    its own), feature and threshold, depth, rows, prediction, class shares."""

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    depth: np.ndarray
    rows: np.ndarray
    prediction: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, model: RandomForestClassificationModel, path: str, spark) -> Forest:
        """Read from the saved model: at most trees x 2**(depth + 1) rows."""
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
            "treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "split.featureIndex",
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "split.numCategories").toPandas()
        if (nodes.numCategories >= 0).any():
            raise ValueError("forests over categorical features are not cut")
        nodes = nodes.sort_values(["treeID", "id"], ignore_index=True)
        at = {k: i for i, k in enumerate(zip(nodes.treeID, nodes.id))}
        child = lambda side: np.array([at[t, c] if c >= 0 else at[t, i] for t, c, i in zip(nodes.treeID, nodes[side], nodes.id)])
        left, right = child("leftChild"), child("rightChild")
        depth = np.zeros(len(nodes), int)
        for k in range(len(nodes)):  # parents come before their children
            if left[k] != k:
                depth[[left[k], right[k]]] = depth[k] + 1
        stats = np.array(nodes.impurityStats.tolist(), float).reshape(len(nodes), -1)
        total = stats.sum(1, keepdims=True)
        return cls(np.flatnonzero(nodes.id == 0), left, right, nodes.featureIndex.to_numpy(), nodes.threshold.fillna(0.0).to_numpy(float),
                   depth, nodes.rawCount.to_numpy(), nodes.prediction.to_numpy(), np.divide(stats, total, out=np.zeros_like(stats), where=total > 0))

    def stops(self, depth: int, least: int) -> np.ndarray:
        """Nodes at which a tree of that depth, whose nodes of fewer than
        ``least`` rows are not split, ends (siblings at the border that predict
        alike are merged, as Spark merges them)."""
        leaf = (self.left == np.arange(len(self.left))) | (self.depth >= depth)
        for k in np.argsort(-self.depth, kind="stable"):
            a, b = self.left[k], self.right[k]
            if not leaf[k] and leaf[a] and leaf[b] and self.prediction[a] == self.prediction[b]:
                leaf[k] = True
        return leaf | (self.rows < least)

    def votes(self, x: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """(rows, trees, classes): the sum of the class shares up to each tree."""
        now = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        every = np.arange(len(x))[:, None]
        while not (done := stop[now]).all():
            goes_left = x[every, self.feature[now]] <= self.threshold[now]
            now = np.where(done, now, np.where(goes_left, self.left[now], self.right[now]))
        return np.cumsum(self.shares[now], axis=1)


def cut_counts(model: RandomForestClassificationModel, rows: DataFrame, cuts: list[tuple[int, int, int]], label: str = "label") -> dict[int, dict]:
    """{number of the cut: {(label, prediction): rows}} of a forest of at least
    that many trees for cuts (trees, depth, least rows of a split node)."""
    spark = rows.sparkSession
    forest = Forest.of(model, f"{ensure_checkpoint_dir(spark).rstrip('/')}/forests/{uuid.uuid4().hex}", spark)
    split = forest.left != np.arange(len(forest.left))
    used = np.unique(forest.feature[split])
    forest.feature = np.searchsorted(used, forest.feature) if len(used) else np.zeros(len(split), int)
    forest.feature[~split] = 0
    slicer = VectorSlicer(inputCol=model.getFeaturesCol(), outputCol="__used", indices=[int(i) for i in used] or [0])
    held = spark.sparkContext.broadcast((forest, {c[1:]: forest.stops(*c[1:]) for c in cuts}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stops = held.value
        found = defaultdict(int)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                labels = part.column("label").to_numpy()
                for shape, stop in stops.items():
                    votes = own.votes(x, stop)
                    for i, cut in enumerate(cuts):
                        if cut[1:] == shape:
                            for pair in zip(labels.tolist(), votes[:, cut[0] - 1].argmax(1).tolist()):
                                found[i, *pair] += 1
        keys = list(found)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.float64()), pa.array([float(k[2]) for k in keys], pa.float64()),
                               pa.array([found[k] for k in keys], pa.int64())], names=["cut", "label", "prediction", "n"])

    x = slicer.transform(rows).select(F.col(label).cast("double").alias("label"), vector_to_array("__used").alias("x"))
    counts = x.mapInArrow(run, "cut long, label double, prediction double, n long").groupBy("cut", "label", "prediction").agg(F.sum("n").alias("n"))
    out = defaultdict(dict)
    for r in counts.collect():  # cuts x classes x classes
        out[r["cut"]][r["label"], r["prediction"]] = r["n"]
    return out


def metric_of(counts: dict, metric: str) -> float:
    """``accuracy`` or ``f1`` (weighted by the labels' rows) of counted (label, prediction) pairs."""
    total = sum(counts.values())
    if not total:
        return 0.0
    if metric == "accuracy":
        return sum(n for (a, b), n in counts.items() if a == b) / total
    if metric != "f1":
        raise ValueError(f"unknown metric {metric}")
    out = 0.0
    for c in {a for a, _ in counts}:
        support, predicted = (sum(n for pair, n in counts.items() if pair[side] == c) for side in (0, 1))
        right = counts.get((c, c), 0)
        out += support / total * (2 * right / (support + predicted))
    return out


def _of_stage(stage, params: dict) -> dict:
    return {p: v for p, v in params.items() if p.parent == stage.uid}


def _key(params: dict, without: tuple = ()) -> tuple:
    return tuple(sorted((p.name, repr(v)) for p, v in params.items() if p.name not in without))


def read_by(stages: list, df: DataFrame, grid: list[dict] = (), label: str = "label") -> DataFrame:
    """The columns of ``df`` that ``stages`` read (with the parameters of any map
    of ``grid``), and ``label``: what is kept of rows that are stored for them."""
    names = {label}
    for stage in stages:
        own = [stage.getParam(name) for name in READ_PARAMS if stage.hasParam(name)]
        if not own:  # it doesn't say
            return df
        for param in own:
            for value in [stage.getOrDefault(param)] if stage.isDefined(param) else []:
                names.update([value] if isinstance(value, str) else value)
            for value in [m[param] for m in grid if param in m]:
                names.update([value] if isinstance(value, str) else value)
    return df.select(*[c for c in df.columns if c in names])


def gathered(stage, df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` in as few tasks as the fit of ``stage`` can use."""
    rows = LINEAR_TASK_ROWS if isinstance(stage, (LogisticRegression, LinearSVC, OneVsRest)) else TASK_ROWS
    return df.coalesce(max(1, -(-n // rows)))


def _is_forest(stage) -> bool:
    return isinstance(stage, RandomForestClassifier) or stage.hasParam("minInstancesSplit")


def _forest_scores(stage, grid: list[dict], ids: list[int], train: DataFrame, held: DataFrame, metric: str) -> dict[int, float]:
    """One fit for each choice of the parameters that no cut can answer."""
    value = lambda i, name: next((v for p, v in grid[i].items() if p.parent == stage.uid and p.name == name), stage.getOrDefault(name) if stage.hasParam(name) else 2)
    cut = {i: tuple(int(value(i, name)) for name in CUT_PARAMS) for i in ids}
    one = min(c[0] for c in cut.values()) == 1
    groups = defaultdict(list)
    for i in ids:
        strategy = value(i, "featureSubsetStrategy")
        rest = _key(_of_stage(stage, grid[i]), (*CUT_PARAMS, "featureSubsetStrategy"))
        # of several trees, "auto" is "sqrt"
        groups[rest, strategy if one else strategy.replace("auto", "sqrt")].append(i)
    out = {}
    for own in groups.values():
        params = {p: v for p, v in _of_stage(stage, grid[own[0]]).items() if p.name not in CUT_PARAMS}
        params |= {stage.numTrees: max(cut[i][0] for i in own), stage.maxDepth: max(cut[i][1] for i in own)}
        model = stage.fit(train, params | ({stage.minInstancesSplit: 2} if stage.hasParam("minInstancesSplit") else {}))
        cuts = sorted({cut[i] for i in own})
        counts = cut_counts(model, held, cuts, stage.getLabelCol())
        out |= {i: metric_of(counts[cuts.index(cut[i])], metric) for i in own}
    return out


def _scores(stages: list, grid: list[dict], ids: list[int], train: DataFrame, held: DataFrame, metric: str) -> dict[int, float]:
    """{map: metric} of one fold, from the first of ``stages`` on."""
    stage, rest = stages[0], stages[1:]
    if not rest and _is_forest(stage):
        return _forest_scores(stage, grid, ids, train, held, metric)
    groups, out = defaultdict(list), {}
    for i in ids:
        groups[_key(_of_stage(stage, grid[i]))].append(i)
    for own in groups.values():
        params = _of_stage(stage, grid[own[0]])
        fitted = stage.fit(train, params) if isinstance(stage, Estimator) else stage.copy(params)
        after = fitted.transform(held)
        if not rest:
            counts = {(float(r[0]), float(r[1])): r[2] for r in after.groupBy(stage.getLabelCol(), "prediction").count().collect()}
            out |= dict.fromkeys(own, metric_of(counts, metric))
            continue
        before = fitted.transform(train)
        if isinstance(stage, CountVectorizer):  # counted once, not by each of the stages after it
            before, after = (cut_lineage(read_by(rest, d, grid)) for d in (before, after))
        if len(rest) == 1:  # what the last stage reads, for all its fits
            before, after = (gathered(rest[0], read_by(rest, d, grid), d.count()).persist(StorageLevel.MEMORY_AND_DISK) for d in (before, after))
        out |= _scores(rest, grid, own, before, after, metric)
        if len(rest) == 1:
            before.unpersist()
            after.unpersist()
    return out


@dataclass
class Search:
    """Maps, their mean scores over the folds, and the pipeline fitted with the
    best on all rows (if asked for)."""

    maps: list[dict]
    avgMetrics: list[float]
    folds: int
    bestModel: object = None

    def getEstimatorParamMaps(self) -> list[dict]:
        return self.maps

    def getNumFolds(self) -> int:
        return self.folds


def cross_validate(pipeline: Pipeline, grid: list[dict], df: DataFrame, fold_col: str = "fold", metric: str = "f1",
                   parallelism: int = PARALLEL, refit: bool = True) -> Search:
    """Every map of ``grid`` on every fold (a column).  Folds, and the choices
    of the first stage, run at once; each is one walk through the trie."""
    stages, folds = pipeline.getStages(), df.agg(F.max(fold_col)).first()[0] + 1
    groups = defaultdict(list)
    for i, params in enumerate(grid):
        groups[_key(_of_stage(stages[0], params)) if len(stages) > 1 else ()].append(i)

    def work(job):
        fold, own = job
        return _scores(stages, grid, own, df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold), metric)

    with ThreadPool(parallelism) as pool:
        done = pool.map(inheritable_thread_target(df.sparkSession)(work), [(f, own) for f in range(folds) for own in groups.values()], chunksize=1)
    sums = np.zeros(len(grid))
    for part in done:
        for i, score in part.items():
            sums[i] += score
    means = (sums / folds).tolist()
    return Search(grid, means, folds, pipeline.fit(df, grid[int(np.argmax(means))]) if refit else None)


def drawn(grid: list[dict], n: int, seed: int = 42) -> list[dict]:
    """``n`` maps of the grid (all, if it has no more), by a seeded draw."""
    return grid if len(grid) <= n else random.Random(seed).sample(grid, n)
