import numpy as np
from pyspark.sql import functions as F

from llm import permutation_index as ann
from llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(vectors, query, k):
    ids = np.array(sorted(i for i in vectors if i != query))
    far = np.sqrt(((np.array([vectors[i] for i in ids]) - vectors[query]) ** 2).sum(axis=1)) if len(ids) else np.empty(0)
    return [(int(ids[j]), float(far[j])) for j in np.lexsort((ids, far))[:k]]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    v = {i: rng.normal(size=8).astype(np.float32) for i in range(120)}
    v.update({200 + i: v[3] for i in range(40)})  # many equal vectors
    rows = [(i, [float(c) for c in x], 0) for i, x in v.items()]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0, None] + [1.0] * 6, 0), (904, [float("inf")] * 8, 0), (905, [], 0),
             (None, [1.0] * 8, 0), (5, [float(c) for c in v[5]], 0)]
    df = frame(spark, rows)
    got = ann.nearest(df, df.where("vec_id in (0, 3, 210, 239, 901)"), "vec_id", "embedding", 10).collect()
    for q in (0, 3, 210, 239):
        mine = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        want = brute({i: x.astype(np.float64) for i, x in v.items()}, q, 10)
        assert [m[0] for m in mine] == [w[0] for w in want]
        assert np.allclose([m[1] for m in mine], [w[1] for w in want], atol=1e-12)
    assert {r.query_id for r in got} == {0, 3, 210, 239}


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    df = frame(spark, [(i, [float(c) for c in r], 0) for i, r in enumerate(x)])
    index, centres = ann.build(df, "vec_id", "embedding", pivots=256, near=48, segment_rows=2000)
    assert index.count() == 6000 and len(centres) == 256
    got = ann.search(index, centres, df.where("vec_id % 100 = 0"), "vec_id", "embedding", share=0.25, least=64)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    vectors = dict(enumerate(x.astype(np.float64)))
    hits = sum(len(found[q] & {i for i, _ in brute(vectors, q, 10)}) for q in range(0, 6000, 100))
    assert hits / 600 >= 0.9


def test_footrule_against_its_definition():
    rng = np.random.default_rng(3)
    orders = np.array([rng.permutation(12)[:5] for _ in range(50)], dtype=np.int32)
    part = ann.Segment(np.arange(50), np.zeros((50, 2)), orders, 12)
    query = rng.permutation(12)[:5]
    place = lambda o, p: list(o).index(p) if p in o else 5
    want = [sum(abs(place(o, p) - place(query, p)) for p in range(12)) for o in orders]
    assert part.footrule(query).tolist() == want


def test_query_and_empty_table(spark, sf, tmp_path):
    got = QUERIES["op1_permutation_index"](spark, sf)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"] and got.where("query_id = vec_id").count() == 0
    empty = frame(spark, [])
    assert ann.nearest(empty, empty, "vec_id", "embedding").collect() == []
    one = frame(spark, [(1, [1.0, 2.0], 0)])
    assert ann.nearest(one, one, "vec_id", "embedding").collect() == []
