"""Word clusters by a batch self-organising map.

Re-aimed from one-sample-at-a-time training to the batch SOM: each round
assigns every word to its best-matching node on the executors (the
codebook, m x m x d, is a small literal broadcast with the task), sums
vectors and counts per node with one aggregation (m x m rows), and the
driver smooths the node sums with the Gaussian neighbourhood to get the
next codebook.  KMeans is the cheap alternative.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.session import cut_lineage


def _bmu_udf(codebook: np.ndarray):
    cb = codebook.copy()

    @F.pandas_udf(T.IntegerType())
    def bmu(vs: pd.Series) -> pd.Series:
        if len(vs) == 0:
            return pd.Series([], dtype="int32")
        X = np.stack(vs.to_numpy())
        d = (X * X).sum(1)[:, None] - 2 * X @ cb.T + (cb * cb).sum(1)[None, :]
        return pd.Series(d.argmin(1).astype("int32"))

    return bmu


def batch_som(vectors: DataFrame, side: int = 32, iterations: int = 10, sigma: float = 0.3,
              seed: int = 42, vec: str = "vec", key: str = "token") -> DataFrame:
    """(token, cluster): winner node of every word after batch training."""
    data = cut_lineage(vectors.select(key, F.col(vec).cast("array<double>").alias("v")))
    dim = len(data.select("v").first()[0])
    rng = np.random.default_rng(seed)
    nodes = side * side
    codebook = rng.uniform(-1, 1, (nodes, dim)) * 0.1
    grid = np.array([(i // side, i % side) for i in range(nodes)], dtype=float)
    g2 = ((grid[:, None, :] - grid[None, :, :]) ** 2).sum(-1)
    for it in range(iterations):
        s = max(sigma * side * (1 - it / max(iterations, 1)), 0.5)
        h = np.exp(-g2 / (2 * s * s))                       # nodes x nodes
        assigned = data.withColumn("b", _bmu_udf(codebook)(F.col("v")))
        sums = (assigned.select("b", F.posexplode("v").alias("d", "x"))
                .groupBy("b", "d").agg(F.sum("x").alias("s")))
        counts = {r["b"]: r["n"] for r in assigned.groupBy("b").agg(F.count("*").alias("n")).collect()}
        S = np.zeros((nodes, dim))
        for r in sums.collect():                            # at most nodes x dim rows
            S[r["b"], r["d"]] = r["s"]
        N = np.zeros(nodes)
        for b, n in counts.items():
            N[b] = n
        num, den = h @ S, h @ N
        upd = den > 1e-12
        codebook[upd] = num[upd] / den[upd, None]
    return data.select(key, _bmu_udf(codebook)(F.col("v")).alias("cluster"))
