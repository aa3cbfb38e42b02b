"""Boosted trees in resumable blocks, their paths as tables, and exact contributions of every feature for every row.

Each round fits one regression tree to Newton steps of the logistic loss (target gradient / hessian, weight hessian) on its own
draw of rows and of columns.  A block of rounds is one barrier stage (``histograms``), whose tasks hold the rows in bins and their
margins; its trees and losses are written to the shared folder.  A run that is started again in the same folder works the margins
out from the trees, goes on behind the last whole block and gives the same trees.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass
from itertools import groupby
from math import factorial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.operators import histograms
from forewarn.plans.fence import fence
from forewarn.sources.io import path_exists

#: The functions that tasks run travel with them, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

col = F.col
NODE_SCHEMA = ("round int, id int, feature int, threshold double, left int, right int, value double, cover double, "
               "gain double")
#: Contributions look up a table of 2^depth entries for each leaf.
DEEPEST = 8


@dataclass
class BoostedTrees:
    """``nodes``: rows of ``NODE_SCHEMA``; at most rounds * 2^(depth + 1), whatever the number of rows."""

    nodes: list[tuple]
    start: float = 0.0
    size: int = 0

    @property
    def rounds(self) -> int:
        return len({r[0] for r in self.nodes})

    def trees(self) -> list[dict[str, np.ndarray]]:
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        frame = pd.DataFrame(self.nodes, columns=names).sort_values(["round", "id"])
        return [{n: g[n].to_numpy() for n in names} for _, g in frame.groupby("round")]

    def margin(self, features: Column) -> Column:
        """Log odds, by batches of rows; ``features`` is a vector column."""
        trees, start = [_walked(t) for t in self.trees()], self.start

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(start + histograms.values_of(np.array(x.tolist(), np.float64).reshape(len(x), -1), trees))

        return run(vector_to_array(features))

    def probability(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-self.margin(features)))

    def importance(self) -> list[float]:
        """Each feature's share of the loss that all splits took away."""
        total = [0.0] * self.size
        for r in self.nodes:
            if r[2] >= 0:
                total[r[2]] += r[8] * r[7]
        return [t / (sum(total) or 1.0) for t in total]

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.start, self.size)], "start double, size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/start")

    @classmethod
    def load(cls, path: str) -> "BoostedTrees":
        spark = SparkSession.active()
        head = spark.read.parquet(f"{path}/start").first()
        return cls(sorted(tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()), head.start, head["size"])


def _walked(tree: dict[str, np.ndarray]) -> dict:
    inner = tree["feature"] >= 0
    if (tree["right"][inner] != tree["left"][inner] + 1).any():
        raise ValueError("the right child must follow the left one")
    return histograms.as_walked(tree["feature"], tree["threshold"], tree["left"], tree["value"])


def fit(rows: DataFrame, folder: str, label: str, key: str, weight: str, test: str, size: int, rounds: int = 500, depth: int = 6,
        rate: float = 0.05, row_share: float = 0.8, column_share: float = 0.8, least_rows: int = 1, bins: int = 32,
        patience: int | None = 30, block: int = 100, seed: int = 42) -> BoostedTrees:
    """Boosts on the rows where ``test`` is false; those where it is true decide when to stop.

    ``rows`` has ``features`` (a vector of ``size``), ``label`` (0/1), ``weight`` and ``key``.  ``patience`` rounds without
    a lower log loss on the test rows end the run, and the trees up to the best round are kept; None runs all ``rounds``.
    ``folder`` belongs to this run: see the module's note on resuming.  One column draw holds for a whole tree.
    """
    spark = rows.sparkSession
    state, at = {"done": 0, "losses": []}, 0
    while path_exists(spark, f"{folder}/block-{at}/state/_SUCCESS"):
        state, at = json.loads(spark.read.text(f"{folder}/block-{at}/state").first().value), at + 1
    if at:
        cuts = [np.array(c) for c in state["cuts"]]
    else:
        found = rows.agg(F.count("*").alias("n"), F.count_if(~col(test)).alias("train"), F.sum(F.when(~col(test), col(weight))).alias("all"),
                         F.sum(F.when(~col(test) & (col(label) == 1), col(weight))).alias("pos")).first()
        share = (found.pos or 0.0) / found.all if found.all else 0.5
        cuts = histograms.borders(rows.where(~col(test)), key, found.train, size, bins)
        state |= {"rows": found.n, "cuts": [c.tolist() for c in cuts],
                  "start": float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0}

    def ended() -> bool:
        losses = state["losses"]
        return state["done"] >= rounds or bool(patience and losses and len(losses) - 1 - int(np.argmin(losses)) >= patience)

    trees = [list(t) for b in range(at) for _, t in groupby(
        sorted(tuple(r) for r in spark.read.parquet(f"{folder}/block-{b}/nodes").collect()), key=lambda r: r[0])]
    held = None if ended() else histograms.Held(histograms.binned(rows, label, weight, test, key, cuts), cuts, state["rows"],
                                                     folder)
    while not ended():
        made, losses = held.boost(trees, state["start"], state["losses"], min(rounds, state["done"] + block), patience, depth, rate,
                                  row_share, column_share, least_rows, seed)
        target, first = f"{folder}/block-{at}", state["done"]
        spark.createDataFrame([n for t in made for n in t], NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{target}/nodes")
        spark.createDataFrame([(first + i, loss) for i, loss in enumerate(losses)], "round int, loss double").coalesce(1).write.mode(
            "overwrite").parquet(f"{target}/scored")
        state = {**state, "done": first + len(made), "losses": state["losses"] + losses}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/state")
        trees, at = trees + made, at + 1
    if held is not None:
        held.close()
    keep = int(np.argmin(state["losses"])) + 1 if patience and state["losses"] else state["done"]
    return BoostedTrees([n for t in trees[:keep] for n in t], state["start"], size)


# --- contributions ---------------------------------------------------------------

def leaf_paths(tree: dict[str, np.ndarray]) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, {feature: (above, up to, share of the cover that follows the path where the feature is unknown)}) per leaf."""
    found, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        f = int(tree["feature"][at])
        if f < 0:
            found.append((float(tree["value"][at]), path))
            continue
        above, upto, share = path.get(f, (-np.inf, np.inf, 1.0))
        cut, cover = float(tree["threshold"][at]), float(tree["cover"][at]) or 1.0
        for side, bounds in (("left", (above, min(upto, cut))), ("right", (max(above, cut), upto))):
            child = int(tree[side][at])
            todo.append((child, {**path, f: (*bounds, share * float(tree["cover"][child]) / cover)}))
    return found


def path_table(model: BoostedTrees, spark: SparkSession, names: list[str]) -> DataFrame:
    """round, leaf, value, feature, above, upto, share: what contributions are made of, one row per leaf and feature."""
    rows = [(n, leaf, value, names[f], *bounds) for n, t in enumerate(model.trees())
            for leaf, (value, path) in enumerate(leaf_paths(t)) for f, bounds in path.items()]
    return spark.createDataFrame(rows, "round int, leaf int, value double, feature string, above double, upto double, share double")


def _looked_up(paths: list[tuple[float, dict]]) -> tuple[np.ndarray, ...]:
    """Of one tree: features, bounds and, for each leaf and set of met intervals, the contribution of each place on the path.

    A leaf's part of the prediction, with some features known, is its value times, for each feature on its path, 1 or 0 for
    known ones that meet the interval or do not, and the share for unknown ones.  The Shapley value of such a product is a
    sum over sizes of sets, whose terms are coefficients of a polynomial.  Shorter paths are filled with features that are
    always met and have a share of 1; they change nothing.
    """
    wide = max(1, max(len(p) for _, p in paths))
    if wide > DEEPEST:
        raise ValueError(f"paths of {wide} features; at most {DEEPEST} are supported")
    feature, above = np.zeros((len(paths), wide), np.int64), np.full((len(paths), wide), -np.inf)
    upto, share = np.full((len(paths), wide), np.inf), np.ones((len(paths), wide))
    for i, (_, path) in enumerate(paths):
        for j, (f, bounds) in enumerate(path.items()):
            feature[i, j], above[i, j], upto[i, j], share[i, j] = f, *bounds
    met = (np.arange(1 << wide)[:, None] >> np.arange(wide)) & 1
    part = np.empty((len(paths), 1 << wide, wide))
    for i in range(wide):
        terms = np.zeros((len(paths), 1 << wide, wide))
        terms[:, :, 0] = 1.0
        for j in (j for j in range(wide) if j != i):
            higher = terms[:, :, :-1] * met[None, :, j, None]
            terms *= share[:, None, j, None]
            terms[:, :, 1:] += higher
        weights = np.array([factorial(k) * factorial(wide - 1 - k) / factorial(wide) for k in range(wide)])
        part[:, :, i] = (terms @ weights) * (met[None, :, i] - share[:, None, i])
    part *= np.array([v for v, _ in paths])[:, None, None]
    return feature, above, upto, part


def _tables(tree: dict[str, np.ndarray]) -> dict:
    """What contributions of one tree look up: a table for each subtree of its lowest two levels (up to four leaves).

    A row's place in a table has a bit for each inner node above, whether the row follows the path to the subtree, and one for each
    inner node inside, whether it goes left; the table holds the sums over the subtree's leaves, feature by feature.
    """
    paths, steps, todo, depth = leaf_paths(tree), [], [(0, [])], 0
    while todo:  # in the order of leaf_paths
        at, way = todo.pop()
        if tree["feature"][at] < 0:
            steps.append(way)
            depth = max(depth, len(way))
            continue
        todo += [(int(tree["left"][at]), [*way, (at, True)]), (int(tree["right"][at]), [*way, (at, False)])]
    *_, part = _looked_up(paths)
    wide, top, found = part.shape[2], max(0, depth - 2), {}
    for leaf, way in enumerate(steps):
        found.setdefault(tuple(way[:top]), []).append(leaf)
    subtrees = []
    for above, leaves in found.items():
        inner = sorted({n for leaf in leaves for n, _ in steps[leaf][top:]})
        bit = {n: i for i, n in enumerate([n for n, _ in above] + inner)}
        places = np.arange(1 << len(bit))
        features = sorted({f for leaf in leaves for f in paths[leaf][1]})
        table = np.zeros((len(features), len(places)))
        for leaf in leaves:
            path = paths[leaf][1]
            met = np.full(len(places), (1 << wide) - (1 << len(path)))  # places that only fill the path are always met
            for j, f in enumerate(path):
                inside = np.ones(len(places), bool)
                for i, (n, left) in enumerate(steps[leaf]):
                    if tree["feature"][n] == f:
                        inside &= (places >> bit[n] & 1 == 1) == (left or i < top)
                met |= inside.astype(np.int64) << j
            for j, f in enumerate(path):
                table[features.index(f)] += part[leaf, :, j].take(met)
        subtrees.append((above, inner, features, table))
    nodes = [(n, int(tree["feature"][n]), float(tree["threshold"][n])) for n in np.flatnonzero(tree["feature"] >= 0).tolist()]
    return {"nodes": nodes, "subtrees": subtrees}


def contributions(df: DataFrame, model: BoostedTrees, names: list[str], keep=("LoanID",), features: str = "features") -> DataFrame:
    """Exact path-dependent Shapley values of every row's log odds: keep, base_value, contributions, risk_probability.

    ``contributions`` is an array of (feature, impact, value) in the order of ``names``; the impacts and ``base_value``, the
    cover-weighted mean of the trees, add up to the margin.  One pass over the rows, in batches; nothing is shuffled.
    """
    trees = model.trees()
    base = model.start + sum(v * np.prod([b[2] for b in p.values()]) for t in trees for v, p in leaf_paths(t))
    tables = [_tables(t) for t in trees]

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), np.float64).reshape(len(x), -1)
        # by columns: each step runs through neighbouring numbers
        columns, out = np.ascontiguousarray(rows.T), np.zeros((len(names), len(rows)))
        for tree in tables:
            left = {n: (columns[f] <= cut).astype(np.uint16) for n, f, cut in tree["nodes"]}
            ways = {(): np.zeros(len(rows), np.uint16)}
            for above, inner, some, table in tree["subtrees"]:
                for i, (n, lower) in enumerate(above):
                    if above[:i + 1] not in ways:
                        ways[above[:i + 1]] = ways[above[:i]] | ((left[n] if lower else left[n] ^ 1) << i)
                at = ways[above]
                for i, n in enumerate(inner, len(above)):
                    at = at | (left[n] << i)
                at = at.astype(np.intp)
                for f, part in zip(some, table):
                    out[f] += part.take(at)
        return pd.Series(list(np.ascontiguousarray(out.T)))

    values = vector_to_array(features)
    # an explode above adds a filter on the array, which would work out everything a second time
    rows = fence(df.select(*keep, values.alias("_x"), run(values).alias("_phi")), "contributions")
    entry = F.transform(F.arrays_zip(F.array(*map(F.lit, names)).alias("f"), col("_phi").alias("p"), col("_x").alias("x")),
                        lambda e: F.struct(e["f"].alias("feature"), e["p"].alias("impact"), e["x"].alias("value")))
    out = rows.select(*keep, F.lit(float(base)).alias("base_value"), entry.alias("contributions"))
    margin = col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, e: a + e["impact"])
    return out.withColumn("risk_probability", 1 / (1 + F.exp(-margin)))
