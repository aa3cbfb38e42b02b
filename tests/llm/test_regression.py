import numpy as np
from pyspark.ml.linalg import Vectors

from llm.regression import LogisticRegression

N, WIDE = 30, 4000


def made(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(N):
        at = sorted({*rng.choice(WIDE - 2, 400, replace=False).tolist(), WIDE - 2, WIDE - 1})
        rows.append((float(i % 3), Vectors.sparse(WIDE, at, [1.0] * (len(at) - 2) + [float(rng.normal()), 1.0])))
    return spark.createDataFrame(rows, ["label", "features"]), np.array([r[1].toArray() for r in rows]), np.array([int(r[0]) for r in rows])


def test_the_gradient_vanishes_and_constant_columns_count_nothing(spark):
    rows, x, y = made(spark)
    w = LogisticRegression(1e-2, 100).fit(rows)
    p = np.exp(x @ w)
    p /= p.sum(axis=1, keepdims=True)
    slope = x.T @ (p - np.eye(3)[y]) / N + 1e-2 * w
    assert w.shape == (WIDE, 3) and not w[-1].any() and w[:-1].any() and np.abs(slope[:-1]).max() < 1e-5


def test_a_round_moves_numbers_of_rows_not_of_columns(spark, monkeypatch):
    seen, image = [], LogisticRegression._image

    def watched(blocks, g):
        out = image(blocks, g)
        seen.append((g.size, out.size))
        return out

    monkeypatch.setattr(LogisticRegression, "_image", staticmethod(watched))
    LogisticRegression(1e-2, 5).fit(made(spark)[0])
    assert seen and all(max(s) <= 3 * N for s in seen)
