import hashlib
import random
import zlib

import pytest
from llm import prefix_trie as pt
from llm.queries import QUERIES, rebuilt
from pyspark.sql import functions as F


def rebuilt_by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {k: [x[2:] for x in sorted(v)] for k, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    """Node by node, subtree by subtree."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    words = {p: len([w for w in p[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if p else 0 for p in members}
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        sums[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[p]) - 1) * words[p])
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), *sums[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, depth string")


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("remainder", [1 << 14, 40])
def test_trie_against_plain_walk(spark, monkeypatch, remainder):
    """Shared beginnings, a crowd of equal conversations, one very long one, odd rows; with and without contraction."""
    monkeypatch.setattr(pt, "SEGMENT", 8)
    monkeypatch.setattr(pt, "STRETCH", 64)
    r = random.Random(4)
    said = ["hello there you", "yes", " no  more\n", "", "a b\tc d"]
    rows = [(c, t, r.choice(["user", "assistant"][: 1 + c % 2]), r.choice(said)) for c in range(90) for t in range(r.randint(1, 6))]
    rows += [(1000 + c, t, "user", "the same thing") for c in range(60) for t in range(3)]  # a crowd with one ending
    rows += [(2000, t, "user", f"turn {t % 7}") for t in range(400)]
    rows += [(3001, None, None, None), (3001, 5, "user", "late"), (3001, 2, None, "two words"), (3002, 1, "b", "x"), (3002, 1, "a", "x"),
             (3003, 1, "a", "again"), (3003, 1, "a", "again"), (None, 1, "user", "nobody"), (9_007_199_254_740_993, 0, "user", "x" * 50_000 + " y")]
    r.shuffle(rows)
    turns = rebuilt(pt.numbered(pt.digested(frame(spark, rows))))
    assert answer(pt.trie(turns, remainder)) == plain(rebuilt_by_hand(rows))


def test_own_turns_alone(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c d"), (3, 0, "u", "a")]
    got = answer(pt.trie(pt.numbered(pt.digested(frame(spark, rows)))))
    assert got == plain({1: [("u", "a"), ("u", "b")], 2: [("u", "a"), ("u", "c d")], 3: [("u", "a")]})
    assert got[0][:5] == (1, 0, None, 3, 1)


def test_empty_and_query(spark, sf):
    assert pt.trie(rebuilt(pt.numbered(pt.digested(frame(spark, []))))).collect() == []
    df = QUERIES["op11_prefix_trie"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(df) == plain(rebuilt_by_hand(rows))
    assert df.dtypes == [(n, "bigint") for n in df.columns[:-1]] + [("ends_sha256", "string")]


def test_list_ranks_of_a_shuffled_list(spark):
    order = list(range(700))
    random.Random(9).shuffle(order)
    arcs = spark.createDataFrame(list(zip(order, [*order[1:], None])), "arc long, next long")
    assert [r.arc for r in pt.list_ranks(arcs, remainder=50).orderBy("rank").collect()] == order


def test_a_parent_of_many_children_is_divided(spark):
    nodes = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent"))
    sums = pt.subtree_sums(nodes, {"n": F.lit(1)}, remainder=2000).collect()
    assert {r.node: r.n for r in sums} == {0: 5000, **{i: 1 for i in range(1, 5000)}}
