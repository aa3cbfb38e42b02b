import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests_llm_common import ODD, prose

from llm import katz


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def brute(train, texts, size):
    """The model written out word by word."""
    c, pairs = Counter(), Counter()
    for t in train:
        c.update(tokens(t))
    N, V = sum(c.values()), len(c)
    Z = N + 0.1 * (V + 1)
    level = lambda n: math.floor(math.log2(n) * 32)
    sizes = Counter(level(n) for n in c.values())
    own, cut = 0, None
    for lv in sorted(sizes, reverse=True):
        if own + sizes[lv] > size:
            break
        own, cut = own + sizes[lv], lv
    known = {w for w, n in c.items() if cut is not None and level(n) >= cut}
    cls = lambda w: w if w in known else "<rare>"
    rare = N - sum(c[w] for w in known) + 0.1 * (V - len(known) + 1)
    uni = lambda k: rare / Z if k == "<rare>" else (c[k] + 0.1) / Z
    for t in train:
        w = [cls(x) for x in tokens(t)]
        pairs.update(zip(["<s>", *w], w))
    n = Counter(pairs.values())
    d = katz.good_turing([0] + [n[r] for r in range(1, 7)])
    after = defaultdict(dict)
    for (h, w), m in pairs.items():
        after[h][w] = m

    def p(h, w):
        if h not in after:
            return uni(w)
        seen = after[h]
        freed = sum(m * (1 - d[m]) for m in seen.values() if m <= 5)
        total = sum(seen.values()) + (0 if freed > 0 else 1)
        left, free = (freed if freed > 0 else 1) / total, 1 - sum(uni(x) for x in seen)
        if w in seen:
            return (d[seen[w]] if seen[w] <= 5 else 1) * seen[w] / total / (1 if free >= 1e-9 else 1 - left)
        return left / free * uni(w)

    out = []
    for t in texts:
        w = tokens(t)
        k = [cls(x) for x in w]
        score = sum(math.log10(p(h, x)) for h, x in zip(["<s>", *k], k))
        score += sum(math.log10((c[x] + 0.1) / rare) for x in w if cls(x) == "<rare>")
        out.append((len(w), sum(x in c for x in w), N, sum(math.log10((c[x] + 0.1) / Z) for x in w), score))
    classes = [*known, "<rare>"]
    assert all(abs(sum(p(h, w) for w in classes) - 1) < 1e-9 for h in list(after)[:30])  # exactly normalised
    return out


@pytest.mark.parametrize("size", [1 << 18, 40, 5])
def test_against_the_definition(docs, size):
    train = [prose(i, 30 + i) for i in range(40)] + [None, "", "the the the end", "The  END"]
    texts = [t for _, t in ODD if t is None or len(t) < 5000] + [prose(7, 20), prose(900, 60), "the", "never-seen the"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "repeat of an id"), (None, "no id")]
    model = katz.fit(docs(train), size=size)
    got = katz.scored(docs(rows), model).collect()
    want = brute(train, [t for _, t in rows], size)
    key = lambda r: (str(r[0]), r[1:3], round(r[4], 6))
    a = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    b = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([x[4:] for x in a], [x[4:] for x in b], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("local", [40, 5, 0])
def test_every_word_keeps_its_bigrams(docs, local):
    """However few words' numbers travel in the tasks, all words have bigrams of their own."""
    train = [prose(i, 30 + i) for i in range(40)] + [None, "", "the the the end", "rare1 rare2 rare1 rare2", "the rare1 the"]
    texts = [prose(7, 20), prose(900, 60), "rare1 rare2", "rare2 rare1 never-seen the", "never-seen rare2", None]
    got = katz.scored(docs(list(enumerate(texts))), katz.fit(docs(train), local=local)).orderBy("doc_id").collect()
    want = brute(train, texts, 1 << 18)
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:3] for w in want]
    assert np.allclose([(r.base_score, r.score) for r in got], [w[3:] for w in want], rtol=1e-9, atol=1e-9)


def test_nothing_to_learn_from(docs):
    model = katz.fit(docs([]))
    got = {r.doc_id: r for r in katz.scored(docs(["a b", None]), model).collect()}
    assert got[0].train_tokens == 0 and got[0].n_known == 0 and (got[0].n_tokens, got[1].n_tokens) == (3, 1)
    assert katz.scored(docs([]), model).collect() == []


def test_discounts():
    assert katz.good_turing([0, 100, 50, 30, 20, 14, 10])[1:].max() < 1
    assert katz.good_turing([0, 1, 0, 0, 0, 0, 0])[1] == 0.5
