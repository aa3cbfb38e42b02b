from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import sharding
from llm.queries import QUERIES


def test_matrix_has_exact_margins():
    m = sharding.communication_matrix([100, 0, 37, 5], [36, 36, 35, 35], 1)
    assert m.sum(axis=0).tolist() == [36, 36, 35, 35] and m.sum(axis=1).tolist() == [100, 0, 37, 5] and (m >= 0).all()


def test_draws_follow_the_law():
    rng = np.random.default_rng(5)
    x = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    assert abs(np.mean(x) - 6) < 0.05 and abs(np.var(x) - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert 0 < sharding.hypergeometric(rng, 10**12, 10**12, 10**5) < 10**5


@pytest.mark.parametrize("rows,shards", [(1000, 16), (7, 16), (1, 3), (0, 4), (500, 1)])
def test_sizes_and_slots(spark, rows, shards):
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shuffle_into_shards(df, shards, "doc_id", seed=3, block_rows=64).collect()
    assert sorted(r.doc_id for r in got) == list(range(rows))
    sizes = Counter(r.shard for r in got)
    assert [sizes[s] for s in range(shards)] == sharding.equal_sizes(rows, shards)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shuffle_is_even_and_repeatable(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"))
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 8, "doc_id", seed=1).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df.repartition(5), 8, "doc_id", seed=1).collect()}
    c = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 8, "doc_id", seed=2).collect()}
    assert a == b and a != c
    pairs = Counter((a[i][0], c[i][0]) for i in a)
    assert max(abs(n - 125) for n in pairs.values()) < 60
    first = [a[i][0] for i in range(1000)]
    assert max(abs(n - 125) for n in Counter(first).values()) < 50
    assert abs(np.corrcoef(list(a), [v[1] for v in a.values()])[0, 1]) < 0.05


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "a"), (1, None)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(df, 2, "doc_id").collect()
    assert len(got) == 5 and sorted(Counter(r.shard for r in got).values()) == [2, 3]
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(df.withColumn("slot", F.lit(1)), 2, "doc_id")


def test_query(spark, sf):
    got = QUERIES["op10_shards"](spark, sf)
    assert {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= set(got.columns)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
