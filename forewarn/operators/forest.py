"""A random forest of weighted Gini trees on rows in bins (``histograms``).

Every tree draws the rows by their keys, so the same rows give the same trees however they are dealt to tasks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.operators import histograms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

col = F.col
#: Trees of one barrier stage; a task that is lost costs no more than these.
BLOCK = 100
FIELDS = ("feature", "threshold", "left", "none", "hit", "gain")


@dataclass
class Forest:
    """``trees``: of each node the feature (-1: a leaf), the threshold, the left child (the right one follows), the weights of
    both classes and what its cut takes off the impurity, times its weight."""

    trees: list[dict[str, np.ndarray]]
    size: int

    def probability(self, features: Column) -> Column:
        """The mean of the trees' shares of class 1, by batches of rows; ``features`` is a vector column."""
        walked = [histograms.as_walked(t["feature"], t["threshold"], t["left"], t["hit"] / np.maximum(t["none"] + t["hit"], 1e-300))
                  for t in self.trees]

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(histograms.values_of(np.array(x.tolist(), np.float64).reshape(len(x), -1), walked) / len(walked))

        return run(vector_to_array(features))

    def importance(self) -> list[float]:
        """The mean over the trees of each feature's share of what a tree's cuts take off."""
        total = np.zeros(self.size)
        for t in self.trees:
            inner = t["feature"] >= 0
            own = np.bincount(t["feature"][inner], t["gain"][inner], self.size)
            total += own / (own.sum() or 1.0)
        return (total / (total.sum() or 1.0)).tolist()

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        columns = {"tree": np.repeat(np.arange(len(self.trees)), [len(t["feature"]) for t in self.trees]),
                   "id": np.concatenate([np.arange(len(t["feature"])) for t in self.trees]),
                   **{n: np.concatenate([t[n] for t in self.trees]) for n in FIELDS}}
        spark.createDataFrame(pa.table(columns)).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.size,)], "size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")

    @classmethod
    def load(cls, path: str) -> "Forest":
        spark = SparkSession.active()
        found = spark.read.parquet(f"{path}/nodes").toArrow().to_pandas().sort_values(["tree", "id"])
        return cls([{n: g[n].to_numpy() for n in FIELDS} for _, g in found.groupby("tree")], spark.read.parquet(f"{path}/size").first()[0])


def fit(rows: DataFrame, folder: str, label: str, key: str, weight: str, test: str, size: int, trees: int, depth: int, least_rows: int,
        seed: int, bins: int = 32) -> Forest:
    """``trees`` trees on the rows where ``test`` is false; ``weight`` is one number for each class."""
    train = ~col(test)
    found = rows.agg(F.count("*").alias("n"), F.count_if(train).alias("train"), F.max(F.when(train & (col(label) == 1), col(weight))).alias("hit"),
                     F.max(F.when(train & (col(label) != 1), col(weight))).alias("none")).first()
    cuts = histograms.borders(rows.where(train), key, found.train, size, bins)
    held = histograms.Held(histograms.binned(rows, label, weight, test, key, cuts), cuts, found.n, folder)
    weights, out = (found.none or 1.0, found.hit or 1.0), []
    try:
        for lo in range(0, trees, BLOCK):
            out += held.grow(range(lo, min(trees, lo + BLOCK)), depth, least_rows, weights, seed)
    finally:
        held.close()
    for t in out:
        inner, cut = t["feature"] >= 0, t.pop("bin")
        t["threshold"] = np.array([cuts[f][b] if i else 0.0 for f, b, i in zip(t["feature"], cut, inner)])
        t["none"], t["hit"] = t["none"] * weights[0], t["hit"] * weights[1]
    return Forest(out, size)
