import math
import random

import numpy as np
import pytest
from llm import hard_negatives as hn
from pyspark.sql import functions as F


def plain(rows, is_anchor, positives=5, negatives=3, lowest=50, highest=95):
    """Row by row over all rows."""
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u)), i, m) for i, m, u in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [x for x in scored if x[2] != lab and lowest * -s <= 100 * -x[0] <= highest * -s]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, condition="id % 5 = 0", **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score string")
    return sorted(tuple(r) for r in hn.mined(df, F.expr(condition), **more).collect())


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_against_all_rows(spark, monkeypatch, spread):
    """Clusters that zone maps tell apart, and noise that they do not."""
    monkeypatch.setattr(hn, "ZONE", 4)
    monkeypatch.setattr(hn, "CHUNK", 16)
    g = np.random.default_rng(7)
    centres = g.normal(size=(6, 10)) * 2
    rows = [(i, int(g.integers(0, 4)), [float(x) for x in centres[i % 6] + g.normal(size=10) * spread], "") for i in range(400)]
    want = plain([r[:3] for r in rows], lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want


def test_odd_rows(spark):
    """Nulls, non-finite components, other lengths, repeated rows and ids, ties, one vector held by a third of all rows."""
    g = random.Random(3)
    rows = [(i, i % 3, [g.choice([-0.5, 0.25, 0.5]) for _ in range(4)], "x") for i in range(60)]
    rows += [(100 + i, 1, [0.5, 0.5, 0.25, 0.5], None) for i in range(40)] + [(5, 2, [0.5, 0.25, 0.5, 0.5], ""), rows[10]]
    odd = [(None, 1, [0.5] * 4, ""), (200, None, [0.5] * 4, ""), (205, 1, None, ""), (210, 1, [0.5, None, 0.5, 0.5], ""),
           (215, 1, [float("nan")] * 4, ""), (220, 1, [float("inf"), 0.0, 0.0, 0.0], ""), (225, 1, [0.5] * 3, ""), (230, 1, [], ""),
           (235, 1, [1e300] * 4, "")]
    want = plain([r[:3] for r in rows], lambda i: i % 5 == 0)
    assert want and mined(spark, rows + odd) == want
    assert mined(spark, []) == [] and mined(spark, rows, "id = -1") == []
    assert mined(spark, [(0, 1, [0.0, 0.0], ""), (5, 1, [0.0, 0.0], "")]) == []


def test_large_components_are_exact(spark):
    g = random.Random(1)
    rows = [(i, i % 2, [g.uniform(-3e5, 3e5) for _ in range(3)], "") for i in range(60)]
    assert mined(spark, rows) == plain([r[:3] for r in rows], lambda i: i % 5 == 0)


def test_curve_goes_through_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = hn.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_leave_blocks_unread(spark):
    """Of well separated clusters an anchor reads few blocks, and the bounds hold for every row of a block."""
    g = np.random.default_rng(2)
    rows = [(i, int(g.integers(0, 3)), [float(x) for x in np.eye(8)[i % 8] * 4 + g.normal(size=8) * 0.02], "") for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, x string")
    sound, dims = hn.quantised(df, "vec_id", "label", "embedding", 256)
    blocks = hn.blocks_of(sound, dims, size=25)
    for b in blocks.collect():
        q = np.frombuffer(b.q, np.int32).reshape(-1, dims)
        assert (q.min(axis=0) == b.low).all() and (q.max(axis=0) == b.high).all() and set(b.kinds) == set(b.labels)
    chunks = hn._anchors(blocks, dims, F.expr("id % 50 = 0"))
    every = chunks.select("chunk", F.posexplode("ids").alias("a", "x")).select("chunk", F.array(F.struct(
        "a", F.lit(0).alias("w"), F.lit(40_000).cast("long").alias("lo"), F.lit(1 << 60).alias("hi"), F.lit(-(1 << 60)).alias("t"))).alias("windows"))
    zones = blocks.groupBy(F.lit(0).alias("zone")).agg(F.collect_list(F.struct("block", "kinds", "low", "high")).alias("zones"))
    asked = hn._chosen_requests(chunks.join(every, "chunk"), zones, dims, True).count()
    assert 0 < asked < 0.3 * 16 * blocks.count()
