"""Softmax regression with an L2 penalty, for few rows and very many sparse columns.

The weights that minimise the mean log loss plus ``penalty`` / 2 times their squares are X^T A for a matrix A of rows x classes,
and so is every step of L-BFGS from zero.  The driver keeps such matrices with their images X X^T A, whose products are the
products of the weights: its memory grows with the rows, never with the columns.  The table is cut by columns into blocks; a round
sends rows x classes numbers to each task, which gives back its block's share of the image.  A line search moves along
images that are known and needs no job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import released, saved

#: Entries of a block on average, and blocks at least, up to the number of cores.
BLOCK = 1 << 20
BLOCKS = 32
#: Steps that L-BFGS remembers.
MEMORY = 10


def _cells(v):
    at = v.indices if hasattr(v, "indices") else range(len(v))
    return [int(i) for i in at], [float(x) for x in (v.values if hasattr(v, "values") else v)]


class LogisticRegression:
    """``fit`` takes rows of ``label`` (0, 1, ... as numbers) and ``features`` (vectors); weights of constant columns are 0.

    It ends after ``rounds`` steps, or when the gradient's length is at most ``close`` times the loss.
    """

    def __init__(self, penalty: float, rounds: int, close: float = 1e-6):
        self.penalty, self.rounds, self.close = penalty, rounds, close

    def fit(self, rows: DataFrame) -> np.ndarray:
        """The weights, columns x classes."""
        width = rows.select("features").first()[0].size
        cells = F.udf(_cells, "struct<at: array<int>, x: array<double>>")("features")
        table = saved(rows.select(F.monotonically_increasing_id().alias("row"), F.col("label").cast("int"), cells.alias("c"))
                      .select("row", "label", "c.at", "c.x"), "regression-rows")
        known = table.select("row", "label").toArrow().sort_by("row")
        ids, y = known["row"].to_numpy(), known["label"].to_numpy()
        blocks = saved(self._blocks(table, ids), "regression-blocks")
        dual = self._minimise(lambda g: self._image(blocks, g), y)
        weights = np.zeros((width, dual.shape[1]))
        found = self._each(blocks, dual, lambda columns, sums, rows, x, many: [columns, sums]).toArrow()
        for columns, sums in zip(found["a"], found["b"]):
            weights[columns.values.to_numpy().astype(np.int64)] = sums.values.to_numpy().reshape(-1, dual.shape[1])
        released(table, blocks)
        return weights

    @staticmethod
    def _blocks(table: DataFrame, ids: np.ndarray) -> DataFrame:
        """columns, ends (of their entries), rows (numbers of the entries' rows), x: one row per block."""
        def pack(cells: pa.Table) -> pa.Table:
            at, row, x = (cells[k].to_numpy() for k in ("at", "row", "x"))
            sort = np.lexsort((row, at))
            at, row, x = at[sort], np.searchsorted(ids, row[sort]), x[sort]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sizes = np.diff(first, append=len(at))
            varies = (sizes < len(ids)) | (np.minimum.reduceat(x, first) < np.maximum.reduceat(x, first))
            keep = np.repeat(varies, sizes)
            lists = at[first][varies], np.cumsum(sizes[varies]), row[keep], x[keep]
            return pa.table({k: pa.array([v], pa.list_(t)) for k, v, t in zip(
                ("columns", "ends", "rows", "x"), lists, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))})

        spark = table.sparkSession
        entries = table.agg(F.sum(F.size("at"))).first()[0] or 0
        many = max(min(BLOCKS, spark.sparkContext.defaultParallelism), entries // BLOCK + 1)
        cells = table.select("row", F.explode(F.arrays_zip("at", "x")).alias("c")).select("row", "c.at", "c.x")
        return cells.groupBy(F.pmod("at", F.lit(many)).alias("block")).applyInArrow(
            pack, "columns array<int>, ends array<int>, rows array<int>, x array<double>")

    @staticmethod
    def _each(blocks: DataFrame, g: np.ndarray, give: Callable) -> DataFrame:
        """What ``give`` makes (two arrays) of each block's columns and their sums of ``g``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    columns, ends, rows, x = (batch[k][i].values.to_numpy() for k in ("columns", "ends", "rows", "x"))
                    if len(columns):
                        sizes = np.diff(ends, prepend=0)
                        sums = np.stack([np.add.reduceat(v[rows] * x, ends - sizes) for v in np.ascontiguousarray(g.T)], axis=1)
                        a, b = give(columns, sums, rows, x, sizes)
                        yield pa.RecordBatch.from_arrays([pa.array([np.ravel(v).astype(float)]) for v in (a, b)], ["a", "b"])

        return blocks.mapInArrow(run, "a array<double>, b array<double>")

    @staticmethod
    def _image(blocks: DataFrame, g: np.ndarray) -> np.ndarray:
        """X X^T g: rows x classes numbers come back from each block."""
        n, size = g.shape

        def back(columns, sums, rows, x, sizes):
            return [], np.stack([np.bincount(rows, np.repeat(v, sizes) * x, n) for v in sums.T], axis=1)

        out = np.zeros(n * size)
        for part in LogisticRegression._each(blocks, g, back).select("b").toArrow()["b"]:
            out += part.values.to_numpy()
        return out.reshape(n, size)

    def _minimise(self, image: Callable[[np.ndarray], np.ndarray], y: np.ndarray) -> np.ndarray:
        """A of the weights X^T A.  Pairs of a matrix and its image stand for weights."""
        n, size = len(y), int(y.max()) + 1
        target = np.eye(size)[y]

        def dot(a, b):
            return float(np.vdot(a[0], b[1]))

        def loss(m):
            top = m.max(axis=1, keepdims=True)
            p = np.exp(m - top)
            total = p.sum(axis=1, keepdims=True)
            return float((np.log(total) + top)[:, 0].mean() - (m * target).sum() / n), (p / total - target) / n

        def gradient(w, off):
            back = image(off[:, 1:])  # the classes of a row sum to zero
            return np.stack([off + self.penalty * w[0], np.column_stack([-back.sum(axis=1), back]) + self.penalty * w[1]])

        w = np.zeros((2, n, size))
        value, off = loss(w[1])
        g, steps = gradient(w, off), []
        for _ in range(self.rounds):
            length = max(0.0, dot(g, g)) ** 0.5
            if length <= self.close * value:
                break
            d, shares = -g, []
            for s, change, by in reversed(steps):
                shares.append(dot(s, d) / by)
                d = d - shares[-1] * change
            if steps:
                d = d * (steps[-1][2] / dot(steps[-1][1], steps[-1][1]))
            for (s, change, by), share in zip(steps, reversed(shares)):
                d = d + (share - dot(change, d) / by) * s
            down, ww, wd, dd = dot(g, d), dot(w, w), dot(w, d), dot(d, d)
            t, low, high = 1.0 if steps else 1 / length, 0.0, np.inf
            for _ in range(40):  # Wolfe's conditions
                new, off = loss(w[1] + t * d[1])
                new += self.penalty / 2 * (ww + 2 * t * wd + t * t * dd)
                slope = float(np.vdot(off, d[1])) + self.penalty * (wd + t * dd)
                if new > value + 1e-4 * t * down or slope > -0.9 * down:
                    high = t
                elif slope < 0.9 * down:
                    low = t
                else:
                    break
                t = (low + high) / 2 if high < np.inf else 2 * t
            else:  # no step that numbers can tell from none
                break
            w, before = w + t * d, g
            value, g = new, gradient(w, off)
            change = g - before
            by = dot(t * d, change)
            if by > 0:
                steps = [*steps, (t * d, change, by)][-MEMORY:]
        self.value, self.length = value, max(0.0, dot(g, g)) ** 0.5
        return w[0]
