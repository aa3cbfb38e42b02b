import random

import pytest
import xxhash
from llm import simhash
from tests_llm_common import ODD, prose


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain(text):
    """Bit by bit, shingle by shingle."""
    words = words_of(text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, radius):
    """Smallest index reachable for each of ``prints`` over links of at most ``radius`` bits."""
    at = list(range(len(prints)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if bin(x ^ prints[j]).count("1") <= radius:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark, docs):
    r = random.Random(5)
    rows = list(ODD)
    for i in range(40):
        text = prose(100 + i, r.choice([3, 40, 400]))
        rows.append((1000 + i, text))
        rows += [(2000 + 10 * i + k, text + f" tail{k}") for k in range(r.choice([0, 0, 3]))]
    rows += [(5000 - i, prose(9, 30)) for i in range(200)]  # a group of copies, smallest id last
    got = simhash.linked(docs(rows)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    prints = [plain(t) for _, t in rows]
    assert sorted((str(i), f"{p:016x}") for (i, _), p in zip(rows, prints)) == sorted((str(g.doc_id), g.fingerprint) for g in got)
    place = reachable(prints, 2)
    least = {}
    for (i, _), p in zip(rows, place):
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    want = sorted((str(i), f"{x:016x}", str(least[p])) for (i, _), x, p in zip(rows, prints, place))
    assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_every_radius_against_all_pairs(spark, radius):
    r = random.Random(radius)
    seeds = [r.getrandbits(64) for _ in range(30)]
    prints = sorted({x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for x in seeds for _ in range(12)} | {0, 1, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    pairs = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), radius).collect()
    assert all(p.a < p.b and bin((p.a ^ p.b) & (1 << 64) - 1).count("1") <= radius for p in pairs) and len(set(pairs)) == len(pairs)
    at = {x: i for i, x in enumerate(signed)}
    edges = [(at[p.a], at[p.b]) for p in pairs]
    mine = list(range(len(prints)))
    for _ in prints:
        for a, b in edges:
            mine[a] = mine[b] = min(mine[a], mine[b])
    assert mine == reachable(prints, radius)


def test_a_crowd_within_one_bit_makes_few_pairs(spark):
    """All 65 fingerprints of a ball lie within two bits of one another: 2,080 links, but not that many pairs."""
    rows = [(m,) for m in simhash._masks(1)]
    pairs = simhash.near_pairs(spark.createDataFrame(rows, "fingerprint long"), 2)
    assert pairs.count() <= 2080 and len({x for p in pairs.collect() for x in p}) == 65


def test_long_texts_are_cut_between_words(monkeypatch):
    text = prose(3, 4000).encode()
    whole = simhash.fingerprint(text, 3, 42)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    assert simhash.fingerprint(text, 3, 42) == whole == plain(text.decode())
    assert simhash.fingerprint(b"x" * 500 + b" y", 3, 42) == plain("x" * 500 + " y")


def test_empty_table_and_text_ids(spark, docs):
    assert simhash.linked(docs([])).collect() == []
    rows = spark.createDataFrame([("b", "same words here", 1), ("a", "same  words HERE", 2), (None, None, 3)], "doc_id string, text string, id int")
    assert {(r.doc_id, r.component_id) for r in simhash.linked(rows).collect()} == {("a", "a"), ("b", "a"), (None, None)}
    with pytest.raises(ValueError):
        simhash.near_pairs(rows, 5)
