import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_common import ODD, prose

from llm import mixing


def posteriors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.6, 0.4, 0.2], n)
    tokens = rng.integers(1, 500, n)
    tokens[0] = 60_000  # one document holds a good part of all tokens
    return spark.createDataFrame([(i, int(tokens[i]), [float(x) for x in p[i]]) for i in range(n)], "id long, n long, p array<double>"), p, tokens


@pytest.mark.parametrize("least,budget", [(0.0, 150_000.0), (1.0, None), (0.0, None)])
def test_expected_totals_match_the_targets(spark, least, budget):
    rows, p, n = posteriors(spark)
    goal = np.array([0.5, 0.3, 0.2])
    out, steps = mixing.rates(rows, goal.tolist(), budget, least, steps=120)
    rate = np.array([r.rate for r in out.orderBy("id").collect()])
    total = (rate * n) @ p
    want = goal * (budget or max((n @ p / goal).max(), n.sum()))
    assert (rate >= least - 1e-12).all()
    # with a lower bound and a document of most tokens the steps come near more slowly
    assert np.allclose(total, want, rtol=2e-2 if least == 0 else 6e-2)


def optimum(p, n, want, least, rounds=200_000):
    """Totals of the least-squares rates by accelerated projected gradient steps, written out."""
    a = (p * np.sqrt(n)[:, None]) / np.sqrt(want)
    low = least * np.sqrt(n)
    x = y = np.sqrt(n).astype(float)
    step, momentum = 1 / np.linalg.eigvalsh(a.T @ a)[-1], 1.0
    for _ in range(rounds):
        new = np.maximum(low, y - step * (a @ (y @ a - np.sqrt(want))))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if (new - x) @ (y - new) > 0:
            after, y = 1.0, new
        else:
            y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return (x @ a) * np.sqrt(want)


@pytest.mark.parametrize("least,budget", [(0.0, 150_000.0), (1.0, None), (0.0, None)])
def test_production_settings_reach_the_optimum(spark, least, budget):
    rows, p, n = posteriors(spark)
    goal = np.array([0.5, 0.3, 0.2])
    out, _ = mixing.rates(rows, goal.tolist(), budget, least)
    rate = np.array([r.rate for r in out.orderBy("id").collect()])
    want = goal * (budget or max((n @ p / goal).max(), n.sum()))
    total, best = (rate * n) @ p, optimum(p, n, want, least)
    print("off the optimum", np.abs(total / best - 1).max(), "off the targets", total / want - 1)
    assert (rate >= least - 1e-12).all() and np.allclose(total, best, rtol=1e-3)


def test_steps_are_those_of_projected_gradient(spark):
    rows, p, n = posteriors(spark, 60, 2)
    out, steps = mixing.rates(rows, [0.2, 0.2, 0.6], 9_000.0, steps=7)
    rate = np.ones(60)
    for s in steps:
        rate = np.maximum(0, rate + p @ np.array(s))
    assert len(steps) <= 7 and np.allclose([r.rate for r in out.orderBy("id").collect()], rate)


def test_classifier_and_copies(docs, spark):
    rows = [(i, prose(i, 60)) for i in range(120)] + [(i, prose(i, 60).upper().replace(" ", "!! ")) for i in range(120, 180)]
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 180, 2)], "doc_id long, quality int")
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    out, mixture = mixing.mixed(docs(rows), labels, domain, {"good": 0.5, "poor": 0.5}, least=1.0)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 180 and all(got[i].p_good > 0.8 for i in range(120)) and all(got[i].p_poor > 0.8 for i in range(120, 180))
    assert all(abs(r.copies - r.rate) < 1 and r.rate >= 1 - 1e-12 for r in got.values())
    again = mixing.resampled(docs(rows), mixture)
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()} == {i: r.copies for i, r in got.items() if r.copies}
    poor = sum(r.copies for i, r in got.items() if i >= 120)
    assert 0.8 < poor / sum(r.copies for i, r in got.items() if i < 120) < 1.3


def test_odd_rows(docs, spark):
    labels = spark.createDataFrame([(4, "a"), (5, "b"), (5, None), (None, "a")], "doc_id long, kind string")
    out, mixture = mixing.mixed(docs(ODD), labels, F.col("kind"), {"a": 1.0, "b": 1.0})
    assert out.count() == len(ODD) and out.where("rate < 0 or isnan(rate)").count() == 0
    assert mixing.resampled(docs([]), mixture).count() == 0
    empty, _ = mixing.mixed(docs([]), labels, F.col("kind"), {"a": 1.0, "b": 1.0})
    assert empty.collect() == []
    none, _ = mixing.mixed(docs(ODD), labels.limit(0), F.col("kind"), {"a": 1.0, "b": 1.0})
    assert {round(r.p_a, 6) for r in none.collect()} == {0.5}


def test_classifier_is_fitted_on_columns_that_occur(spark, docs, monkeypatch):
    widths = []

    class Narrow(mixing.LogisticRegression):
        def fit(self, rows, *args):
            widths.append(rows.first().features.size)
            return super().fit(rows, *args)

    monkeypatch.setattr(mixing, "LogisticRegression", Narrow)
    texts = [f"{'good' if i % 2 else 'bad'} word{i % 7}" for i in range(60)]
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(60)], "doc_id long, d string")
    found = mixing.fit(docs(texts), labels, F.col("d"), ["a", "b"])
    assert widths and widths[0] <= 9 + mixing.FEATURES and found.weights.shape == (mixing.BUCKETS + mixing.FEATURES, 2)
    used = mixing.buckets(" ".join(texts))
    assert (found.weights[used] != 0).all() and np.count_nonzero(found.weights[:mixing.BUCKETS].any(axis=1)) == len(used)
    assert found.posteriors(["good word1", "bad word2", "neither"])[1][:2].argmax(axis=1).tolist() == [0, 1]
