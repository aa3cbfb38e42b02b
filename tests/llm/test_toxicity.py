import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_common import ODD, prose

from llm import toxicity

INSULTS = ["numbskull", "dimwit", "blockhead", "lowlife"]


def corpus(n, share=0.25):
    r, rows, labels = random.Random(1), [], []
    for i in range(n):
        words = prose(10_000 + i, r.randint(20, 200)).split()
        toxic = r.random() < share
        for _ in range(r.randint(2, 6) * toxic):
            words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learnt(docs, spark):
    rows, labels = corpus(900)
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    known = spark.createDataFrame([x for x in labels if x not in held], "doc_id long, toxic int")
    return docs(rows), toxicity.fit(docs(rows), known), dict(held)


def test_held_out_accuracy(learnt):
    df, model, held = learnt
    got = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    y, s = np.array(list(held.values())), np.array([got[i].score for i in held])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    assert auc > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    flagged = np.array([got[i].predicted for i in held])
    assert flagged[y == 0].mean() < 0.03 and flagged[y == 1].mean() > 0.6


def held_out_auc(docs, spark, rows, labels):
    """AUC and recall on the rows that labels may not be learnt from, and the share of clean ones flagged."""
    held = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    known = spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id long, toxic int")
    df = docs(rows)
    got = {r.doc_id: r for r in toxicity.scored(df, toxicity.fit(df, known)).collect()}
    y, s = np.array(list(held.values())), np.array([got[i].score for i in held])
    flagged = np.array([got[i].predicted for i in held])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    return auc, flagged[y == 1].mean(), flagged[y == 0].mean()


def test_a_phrase_that_recurs_verbatim(docs, spark):
    r, rows, labels = random.Random(3), [], []
    phrase = prose(77, 9).split()  # words that ordinary documents have too
    for i in range(1500):
        words, toxic = prose(20_000 + i, r.randint(20, 200)).split(), r.random() < 0.25
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = phrase
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    auc, recall, wrong = held_out_auc(docs, spark, rows, labels)
    print("phrase", auc, recall, wrong)
    assert auc > 0.95 and recall > 0.9 and wrong < 0.03


def test_a_large_lexicon(docs, spark):
    r, rows, labels = random.Random(4), [], []
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(600)]
    for i in range(3000):
        words, toxic = prose(40_000 + i, r.randint(20, 200)).split(), r.random() < 0.25
        for _ in range(r.randint(3, 8) * toxic):
            words.insert(r.randrange(len(words)), r.choice(lexicon))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    auc, recall, wrong = held_out_auc(docs, spark, rows, labels)
    print("lexicon", auc, recall, wrong)
    assert auc > 0.95 and recall > 0.8 and wrong < 0.03


@pytest.mark.xfail(reason="open: a shifted copy's first passage differs in each copy, so its inner words count as a phrase that recurs")
def test_copied_toxic_documents_count_once(docs, spark):
    """A family of copies at shifted places does not make its own ordinary words typical."""
    rows, labels = corpus(600)
    one = prose(99, 80) + " " + INSULTS[0]
    for i in range(600, 700):
        rows.append((i, prose(i, i % 7) + " " + one))
        labels.append((i, 1))
    df, known = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = toxicity.scored(docs([(1, prose(99, 80)), (2, prose(98, 80))]), model).collect()
    assert all(r.predicted == 0 for r in got)


def test_terms_travel_without_their_passages(docs, spark, monkeypatch):
    kept, found = toxicity.saved, {}

    def watched(df, name):
        out = kept(df, name)
        found[name] = out.columns, out.collect()
        return out

    monkeypatch.setattr(toxicity, "saved", watched)
    rows, labels = corpus(120)
    rows[0], labels[0] = (0, "you dimwit you dimwit you"), (0, 1)
    toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    columns, terms = found["toxic-terms"]
    assert "passage" not in columns
    passages = {r.number: r for r in found["toxic-passages"][1]}
    assert len(passages) == len(found["toxic-passages"][1]) == len({(bytes(r.passage), r.y) for r in passages.values()})
    want = []
    for r in passages.values():
        words = bytes(r.passage).split()
        want += [(r.number, i, n, b" ".join(words[i: i + n])) for n in (1, 2) for i in range(len(words) - n + 1) if r.y]
    assert sorted((r.number, r.at, r.n, bytes(r.term)) for r in terms) == sorted(want)
    # each term of a passage counts once
    firsts = [(r.number, bytes(r.term)) for r in terms if r.first]
    assert len(firsts) == len(set(firsts)) and set(firsts) == {(x[0], x[3]) for x in want} and len(firsts) < len(want)
    assert all(passages[r.number].passage == r.passage and passages[r.number].fold == r.fold for r in found["toxic-typical"][1])


def test_savings_are_those_of_plain_compression(learnt):
    df, model, _ = learnt
    tool = toxicity.Distance(model)
    texts = [r.text for r in df.limit(40).collect()] + ["", None, "one"]
    want = []
    for text in texts:
        words, saved = (text or "").lower().split(), []
        for at in range(0, max(1, len(words)), toxicity.STRIDE):
            if words and (at == 0 or at + toxicity.WINDOW - toxicity.STRIDE < len(words)):
                window = (" " + " ".join(words[at: at + toxicity.WINDOW]) + " ").encode()
                saved.append(len(tool.tools[0].compress(window)) - len(tool.tools[1].compress(window)))
        want.append([max([0, *saved]), sum(max(0, x - toxicity.CLEAR + 1) for x in saved), len(saved)])
    assert np.array_equal(tool.evidence(texts), np.array(want, dtype=float))


def test_odd_rows_and_dropping(learnt, docs):
    _, model, _ = learnt
    rows = ODD + [(50, " ".join([prose(1, 30)] + INSULTS * 4))]
    got = toxicity.scored(docs(rows), model).collect()
    assert len(got) == len(rows) and [r.predicted for r in got if r.doc_id == 50] == [1]
    kept = toxicity.drop_toxic(docs(rows), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(rows) - sum(r.predicted for r in got)
    assert toxicity.scored(docs([]), model).collect() == []


def test_windows_cover_every_word():
    parts = [b"a bb ccc dd e f g h i j k l m n o p q", b"", b"  x  ", b"one"]
    data, part, offsets, lengths = toxicity.windows(parts, window=4, stride=3)
    for i, p in enumerate(parts):
        seen = b" ".join(data[o: o + n] for k, o, n in zip(part, offsets, lengths) if k == i).split()
        assert set(seen) == set(p.split())


def test_labels_of_one_class_or_none(docs, spark):
    rows, labels = corpus(20)
    only = spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs(rows), toxicity.fit(docs(rows), only)).collect()} == {0.0}
    assert {r.score for r in toxicity.scored(docs(rows), toxicity.fit(docs(rows), only.limit(0))).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs(rows), odd).constant == 1.0


def test_held_out_rows(spark):
    df = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in df.collect())
