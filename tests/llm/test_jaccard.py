import random

import pytest
from tests_llm_common import ODD, prose
from llm import jaccard_join
from llm.components import components


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, width):
    w = words(t)
    return frozenset(zip(*[w[i:] for i in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and (den * len(x & y) >= num * len(x | y)):
                parent[find(a)] = find(b)
    # rows of one id are one document
    by_id = {}
    for a, (i, _) in enumerate(sets):
        if i is not None and i in by_id:
            parent[find(a)] = find(by_id[i])
        by_id[i] = a
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a), i) if s else i) for a, (i, s) in enumerate(sets)), key=str)


def near_copies(n, size, edits, seed):
    r = random.Random(seed)
    base = prose(seed, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            kind, at = r.random(), r.randrange(len(w))
            if kind < 0.5:
                w[at] = prose(r.randrange(10**6), 1)
            elif kind < 0.75:
                del w[at]
            else:
                w.insert(at, "and")
        out.append(" ".join(w))
    return out


def run(docs, rows, width=3, num=90, den=100):
    got = jaccard_join.linked(docs(rows), width=width, num=num, den=den).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("width,num,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_against_all_pairs(docs, width, num, seed):
    passage = prose(99, 60)
    texts = (near_copies(60, 90, 5, seed) + near_copies(25, 12, 2, seed + 10) + [prose(i, 30) + " " + passage for i in range(30)]
             + [passage] * 4 + ["", None, "a", "A", "a b", "a  B "])
    random.Random(seed).shuffle(texts)
    rows = list(enumerate(texts))
    assert run(docs, rows, width, num) == brute(rows, width, num, 100)


def test_odd_rows(docs):
    rows = [r for r in ODD if r[0] is not None]
    assert run(docs, rows) == brute(rows, 3, 90, 100)
    assert {r[2] for r in run(docs, ODD) if r[0] is None} == {None}


def test_drop_near_keeps_the_smallest(docs):
    texts = near_copies(12, 200, 1, 5) + [prose(i + 500, 50) for i in range(5)]
    got = jaccard_join.drop_near(docs(texts))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(12, 17)]


def test_empty_table(docs):
    assert run(docs, []) == []


def test_bounds_never_exclude_a_partner():
    for num in (50, 80, 90, 100):
        b = jaccard_join.Bounds(num, 100)
        for n in range(1, 200):
            assert 1 <= b.lead(n) <= b.span(n) <= n and b.need(n) * 100 >= num * n > (b.need(n) - 1) * 100


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 199), (300, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 199: 199, 200: 199}
