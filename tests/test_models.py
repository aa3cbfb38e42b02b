import math
import random
import threading
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from forewarn import catalog
from forewarn.operators import boosting, forest, histograms, metrics, ml
from forewarn.sources.io import work_dir

col = F.col


@pytest.fixture(scope="module")
def model(spark, sf):
    return ml.fit(catalog.featured(spark, sf), trees=3, forest=8, early_stop=False)


def test_features_leave_labels_out(spark, sf):
    f = catalog.featured(spark, sf).withColumn("delinquency_prob", F.lit(0.1)).withColumn("target", F.lit(1))
    numeric, text = ml.feature_columns(f)
    assert not {"LoanID", "Default", "target", "delinquency_prob", "customer_id"} & {*numeric, *text}
    assert not [c for c in text if c.endswith("_band")] and text == ["segment_category", "detailed_segment"]


def test_transform_weights_and_unseen_category(spark, sf, model):
    m, test = model
    f = catalog.featured(spark, sf).limit(50).withColumn("detailed_segment", F.lit("NEVER_SEEN"))
    out = m.transform(f)
    p = out.select(F.abs(col("ensemble_probability") - ml.weighted_probability(list(m.models))).alias("d"), "ensemble_probability").collect()
    assert len(p) == 50 and max(r.d for r in p) < 1e-12 and all(0 <= r.ensemble_probability <= 1 for r in p)
    prepared = ml.prepare(f, m.prep).select(vector_to_array("features").alias("v")).first().v
    assert prepared[m.features.index("detailed_segment")] == -1.0
    assert -999.0 in prepared


def test_fallback_probability(spark, sf, model):
    out = model[0].transform(spark.range(3).withColumnRenamed("id", "LoanID"))
    assert {r.ensemble_probability for r in out.collect()} == {0.5}


def test_scaled_vectors_have_unit_population_deviation(spark, sf, model):
    m, _ = model
    path_rows = m.scaler.transform(ml.prepare(catalog.featured(spark, sf), m.prep))
    i = m.features.index("DTIRatio")
    sd = path_rows.select(vector_to_array("scaled")[i].alias("x")).agg(F.stddev_pop("x")).first()[0]
    assert sd == pytest.approx(1.0, abs=0.05)


def test_save_load(spark, sf, model):
    m, _ = model
    path = work_dir(spark, "model")
    m.save(path)
    back = ml.EnsembleModel.load(path)
    f = catalog.featured(spark, sf).limit(20)
    a = [r[0] for r in m.transform(f).orderBy("LoanID").select("ensemble_probability").collect()]
    b = [r[0] for r in back.transform(f).orderBy("LoanID").select("ensemble_probability").collect()]
    assert a == pytest.approx(b) and back.threshold == m.threshold and back.features == m.features


def test_auc_against_pair_counting(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.1, 1), (0.9, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "s", "y").first().auc == pytest.approx(want)
    best = metrics.best_f1_threshold(df, "s", "y").first()
    f1 = lambda t: 2 * sum(p >= t for p in pos) / (sum(s >= t for s, _ in rows) + len(pos))
    assert best.f1 == pytest.approx(max(f1(t) for t, _ in rows), abs=1e-6)


def test_cost_curve_on_edges(spark):
    df = spark.createDataFrame([(0.1, 1), (0.5, 0), (0.05, 0), (0.95, 1), (0.89, 0)], "s double, y int")
    got = {round(r.threshold, 2): (r.fp, r.fn) for r in metrics.cost_curve(df, "s", "y").collect()}
    step = (0.1 + 0.01) - 0.1
    want = {round(0.1 + i * step, 2): (sum(y == 0 and s >= 0.1 + i * step for s, y in [(0.5, 0), (0.05, 0), (0.89, 0)]),
                                       sum(s < 0.1 + i * step for s in (0.1, 0.95))) for i in range(80)}
    assert got == want


def shapley_by_definition(tree, x, features):
    """Over all sets of the other features; an unknown feature's split counts both sides by their covers."""
    def value(at, known):
        f = tree["feature"][at]
        if f < 0:
            return tree["value"][at]
        left, right = tree["left"][at], tree["right"][at]
        if f in known:
            return value(left if x[f] <= tree["threshold"][at] else right, known)
        return (tree["cover"][left] * value(left, known) + tree["cover"][right] * value(right, known)) / tree["cover"][at]

    out, n = [], len(features)
    for f in features:
        others = [g for g in features if g != f]
        out.append(sum(factorial(k) * factorial(n - 1 - k) / factorial(n) * (value(0, {*s, f}) - value(0, {*s}))
                       for k in range(n) for s in combinations(others, k)))
    return out


def boosted_rows(spark, n=400, width=8):
    r = random.Random(11)
    rows = []
    for i in range(n):
        x = [r.choice([0.0, 1.0, 2.0, r.random()]) for _ in range(width)]
        rows.append((i, int(x[0] + x[1] * x[2] + r.random() > 2), 1.0, i % 5 == 0, Vectors.dense(x)))
    return spark.createDataFrame(rows, ["LoanID", "y", "w", "t", "features"])


def test_boosting_resumes_and_contributions_are_exact(spark, tmp_path):
    df = boosted_rows(spark)
    args = ("y", "LoanID", "w", "t", 8)
    options = dict(block=2, depth=5, rate=0.3, patience=None)
    whole = boosting.fit(df, f"file://{tmp_path}/whole", *args, rounds=6, **options)
    half = boosting.fit(df, f"file://{tmp_path}/half", *args, rounds=2, **options)
    again = boosting.fit(df, f"file://{tmp_path}/half", *args, rounds=6, **options)
    assert half.nodes == whole.nodes[:len(half.nodes)] and again.nodes == whole.nodes and whole.rounds == 6
    names = [f"f{i}" for i in range(8)]
    got = boosting.contributions(df, whole, names, keep=("LoanID", "features")).collect()
    margins = {r.LoanID: r.m for r in df.select("LoanID", whole.margin(F.col("features")).alias("m")).collect()}
    assert len(got) == 400
    for r in got:
        assert r.base_value + sum(c.impact for c in r.contributions) == pytest.approx(margins[r.LoanID], abs=1e-9)
        assert r.risk_probability == pytest.approx(1 / (1 + math.exp(-margins[r.LoanID])))
    for r in got[:12]:
        want = [sum(v) for v in zip(*(shapley_by_definition(t, list(r.features), range(8)) for t in whole.trees()))]
        assert [c.impact for c in r.contributions] == pytest.approx(want, abs=1e-9)
    back = f"file://{tmp_path}/saved"
    whole.save(back)
    assert boosting.BoostedTrees.load(back) == whole
    hits = df.where("t").select("y", whole.probability(F.col("features")).alias("p"))
    assert metrics.roc_auc(hits, "p", "y").first().auc > 0.8
    assert boosting.path_table(whole, spark, names).where("share <= 0 or share > 1 or above >= upto").count() == 0


def test_exploded_contributions_are_worked_out_once(spark):
    trees, names = catalog.given_booster(), catalog.GIVEN_FEATURES
    # a path of one feature, one of two and one of three that are met or not, and a row on a cut
    rows = spark.createDataFrame([(1, Vectors.dense(30.0, 600.0, 30.0, 5e4)), (2, Vectors.dense(40.0, 700.0, 50.0, 7e4))], ["LoanID", "features"])
    out = boosting.contributions(rows, trees, names).select("LoanID", F.explode("contributions").alias("c")).select("LoanID", "c.feature", "c.impact")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(") == 1, plan
    got = {(r.LoanID, r.feature): r.impact for r in out.collect()}
    for r in rows.collect():
        want = [sum(v) for v in zip(*(shapley_by_definition(t, list(r.features), range(4)) for t in trees.trees()))]
        assert [got[r.LoanID, f] for f in names] == pytest.approx(want, abs=1e-12)


def test_early_stop_keeps_the_best_round(spark, tmp_path):
    noise = boosted_rows(spark, 200).withColumn("y", (F.xxhash64("LoanID") % 2 == 0).cast("int"))
    model = boosting.fit(noise, f"file://{tmp_path}/noise", "y", "LoanID", "w", "t", 8, rounds=40, rate=1.0, patience=3, block=4)
    assert 1 <= model.rounds < 40


def test_a_boosting_round_reads_its_rows_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(v):
        read.add(1)
        return v

    rows = boosted_rows(spark, 300).coalesce(1).withColumn("features", F.udf(counted, VectorUDT()).asNondeterministic()("features"))
    boosting.fit(rows, f"file://{tmp_path}/once", "y", "LoanID", "w", "t", 8, rounds=1, patience=None)
    # once for the tree, once for the margins
    assert 300 < read.value <= 600


def test_forest_keeps_the_nodes_of_rows_and_small_histograms():
    forest = ml.estimator("random_forest", "Default", 100, 300)
    assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() <= 256
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (300, 12, 10)


def test_linear_contributions_add_up(spark, sf):
    c = catalog._contributions(spark, sf)
    d = c.select(F.abs(F.col("risk_probability") - 1 / (1 + F.exp(-(F.col("base_value") + F.aggregate(
        "contributions", F.lit(0.0), lambda a, e: a + e["impact"]))))).alias("d")).agg(F.max("d")).first()[0]
    assert d < 1e-12


def test_queries_of_one_model_fit_that_model_alone(spark, sf, monkeypatch):
    fitted = []
    monkeypatch.setattr(ml.Training, "_fit", lambda self, name, own=ml.Training._fit: (fitted.append(name), own(self, name))[1])
    monkeypatch.setattr(catalog, "ROUNDS", dict(trees=2, forest=4))
    for cache in (catalog._training, catalog._fitted):
        cache.cache_clear()
    try:
        n = catalog.featured(spark, sf).count()
        assert catalog.QUERIES["m3_standardised_vectors"](spark, sf).count() == n and fitted == []
        alone = catalog.QUERIES["m7_logistic"](spark, sf).orderBy("LoanID").collect()
        assert fitted == ["logistic"]
        whole = catalog.fitted(spark, sf)[0]
        assert sorted(fitted) == sorted(whole.models) and len(whole.models) == 4
        both = whole.transform(catalog.featured(spark, sf)).orderBy("LoanID").select("LoanID", "p_logistic").collect()
        assert len(alone) == n and alone == both
    finally:
        for cache in (catalog._training, catalog._fitted):
            cache.cache_clear()


def test_models_asked_for_together_are_fitted_side_by_side(spark, sf, monkeypatch):
    training = ml.Training(catalog.featured(spark, sf), trees=1, forest=1)
    meet = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(training, "_fit", lambda name: (meet.wait(), name)[1])
    assert training.models(("booster_a", "booster_b")) == {"booster_a": "booster_a", "booster_b": "booster_b"}
    order = []
    monkeypatch.setattr(training, "_fit", order.append)
    training.models(("random_forest", "logistic"))
    assert order == ["logistic", "random_forest"]


def test_a_boosting_block_writes_its_rows_once(spark, tmp_path):
    boosting.fit(boosted_rows(spark, 60), f"file://{tmp_path}/block", "y", "LoanID", "w", "t", 8, rounds=3, block=2, patience=None)
    for block in ("block-0", "block-1"):
        assert {p.name for p in (tmp_path / "block" / block).iterdir()} == {"nodes", "scored", "state"}


def test_a_round_walks_only_the_tree_before_it(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(v):
        read.add(1)
        return v

    rows = boosted_rows(spark, 200).coalesce(1).withColumn("features", F.udf(counted, VectorUDT()).asNondeterministic()("features"))
    boosting.fit(rows, f"file://{tmp_path}/walk", "y", "LoanID", "w", "t", 8, rounds=4, block=4, patience=None)
    # once for the first tree and once for the margins that all later rounds go on from
    assert 200 < read.value <= 400


def test_model_queries_boost_as_long_as_ml_fit(spark, sf):
    catalog._training.cache_clear()
    try:
        training = catalog._training(spark.sparkContext.applicationId, sf)
        assert (training.trees, training.forest, training.early_stop) == (500, 300, True)
    finally:
        catalog._training.cache_clear()


def test_a_round_finds_the_best_cut_of_all(spark, tmp_path):
    df = boosted_rows(spark, 300, 4)
    got = boosting.fit(df, f"file://{tmp_path}/cut", "y", "LoanID", "w", "t", 4, rounds=1, depth=1, row_share=1.0, column_share=1.0,
                       least_rows=20, bins=256, patience=None)
    rows = [(list(r.features), r.y) for r in df.where("not t").collect()]
    p = 1 / (1 + math.exp(-got.start))

    def gain(f, cut):
        sides = [[y for x, y in rows if (x[f] <= cut) == lower] for lower in (True, False)]
        if min(map(len, sides)) < 20:
            return -1.0
        return sum(sum(y - p for y in s) ** 2 / (len(s) * p * (1 - p)) for s in sides)

    best = max(gain(f, x[f]) for x, _ in rows for f in range(4))
    root, *leaves = got.nodes
    assert gain(root[2], root[3]) == pytest.approx(best)
    lower = [y for x, y in rows if x[root[2]] <= root[3]]
    assert leaves[0][6] == pytest.approx(0.05 * sum(y - p for y in lower) / (len(lower) * p * (1 - p)))
    assert leaves[0][7] + leaves[1][7] == pytest.approx(root[7]) and len(leaves) == 2


def test_tasks_of_a_barrier_stage_make_the_trees_of_one_task(spark, tmp_path, monkeypatch):
    df = boosted_rows(spark, 400).repartition(6)
    args = ("y", "LoanID", "w", "t", 8)
    alone = boosting.fit(df, f"file://{tmp_path}/alone", *args, rounds=5, patience=None)
    monkeypatch.setattr(histograms, "LEAST", 100)
    several = boosting.fit(df, f"file://{tmp_path}/several", *args, rounds=5, patience=None)
    assert [r[:6] for r in several.nodes] == [r[:6] for r in alone.nodes]
    assert [v for r in several.nodes for v in r[6:]] == pytest.approx([v for r in alone.nodes for v in r[6:]])
    assert {p.name for p in (tmp_path / "several").iterdir()} == {"block-0"}


def test_forest_draws_rows_by_their_keys_and_keeps_its_leaves_large(spark, tmp_path, monkeypatch):
    df = boosted_rows(spark, 600).withColumn("w", F.when(col("y") == 1, 3.0).otherwise(0.5)).repartition(6)
    args = ("y", "LoanID", "w", "t", 8, 6, 5, 10, 42)
    alone = forest.fit(df, f"file://{tmp_path}/alone", *args)
    monkeypatch.setattr(histograms, "LEAST", 100)
    several = forest.fit(df.repartition(3), f"file://{tmp_path}/several", *args)
    assert len(alone.trees) == 6 and not any((tmp_path / "several").iterdir())
    for a, b in zip(alone.trees, several.trees):
        assert all((a[n] == b[n]).all() for n in ("feature", "threshold", "left", "none", "hit"))
        leaves, inner = a["feature"] < 0, np.flatnonzero(a["feature"] >= 0)
        assert (a["none"] / 0.5 + a["hit"] / 3.0)[leaves].min() >= 10 and len(inner)
        for n in ("none", "hit"):
            assert a[n][inner] == pytest.approx(a[n][a["left"][inner]] + a[n][a["left"][inner] + 1])
    # each tree has its own rows
    assert len({t["none"][0] for t in alone.trees}) > 1
    hits = df.where("t").select("y", alone.probability(F.col("features")).alias("p"))
    assert metrics.roc_auc(hits, "p", "y").first().auc > 0.75
    assert sum(alone.importance()) == pytest.approx(1) and max(alone.importance()[:3]) > max(alone.importance()[3:])
    alone.save(f"file://{tmp_path}/saved")
    back = forest.Forest.load(f"file://{tmp_path}/saved")
    x = F.col("features")
    assert df.where(F.abs(alone.probability(x) - back.probability(x)) > 1e-12).count() == 0


def test_a_node_of_the_forest_is_cut_where_the_weighted_gini_impurity_falls_most():
    r = np.random.default_rng(5)
    counts, weights = r.integers(0, 9, (3, 4, 6, 2)).astype(float), (0.7, 2.0)
    asked = np.array([[0, 1, 2, 3]] * 3)
    counts[1] = counts[1, :1]
    # all features hold the same rows
    for f in range(1, 4):
        counts[:, f] = r.permuted(counts[:, 0], axis=1)
        counts[:, f, :, 1] += (counts[:, 0, :, 1].sum(axis=1) - counts[:, f, :, 1].sum(axis=1))[:, None] / 6
        counts[:, f, :, 0] += (counts[:, 0, :, 0].sum(axis=1) - counts[:, f, :, 0].sum(axis=1))[:, None] / 6
    got = histograms.purest(counts, asked, np.array([6, 6, 6, 6]), weights, 8)

    def impurity(c):
        w = c * weights
        return 0.0 if not w.sum() else w.sum() * (1 - ((w / w.sum()) ** 2).sum())

    for node in range(3):
        all_ = counts[node, 0].sum(axis=0)
        sides = {(f, b): (counts[node, f, :b + 1].sum(axis=0), counts[node, f, b + 1:].sum(axis=0)) for f in range(4) for b in range(5)}
        want = max(impurity(all_) - impurity(a) - impurity(b) for a, b in sides.values() if min(a.sum(), b.sum()) >= 8)
        a, b = sides[int(got[node, 0]), int(got[node, 1])]
        assert got[node, 2] == pytest.approx(want) == pytest.approx(impurity(all_) - impurity(a) - impurity(b))
        assert got[node, 3:5] == pytest.approx(a) and got[node, 5:7] == pytest.approx(all_)


def test_contributions_look_up_a_subtree_at_once():
    # 64 leaves over three features, so that every path meets features again
    rows, r = [], random.Random(3)
    for i in range(127):
        rows.append((0, i, i % 3, r.random(), 2 * i + 1, 2 * i + 2, 0.0, 0.0, 1.0) if i < 63 else (0, i, -1, 0.0, -1, -1, r.random(), 10.0, 0.0))
    for i in range(62, -1, -1):
        rows[i] = (*rows[i][:7], rows[2 * i + 1][7] + rows[2 * i + 2][7], 1.0)
    tree = boosting.BoostedTrees(rows, 0.0, 3).trees()[0]
    tables = boosting._tables(tree)["subtrees"]
    assert len(tables) == 16 and all(t.shape[1] == 2 ** 7 for *_, t in tables)
    for _ in range(5):
        x = [r.random() for _ in range(3)]
        got = np.zeros(3)
        for above, inner, features, table in tables:
            lower = [(x[tree["feature"][n]] <= tree["threshold"][n]) == left for n, left in [*above, *((n, True) for n in inner)]]
            for f, part in zip(features, table):
                got[f] += part[sum(b << i for i, b in enumerate(lower))]
        assert got == pytest.approx(shapley_by_definition(tree, x, range(3)), abs=1e-12)
