import random
import zlib
from collections import Counter

import pytest
import public_tokenizers as P
from tests_llm_common import ODD, prose
from tokenizers import Tokenizer

from llm import packing
from llm.queries import VOCABULARY
from llm.tokens import Encoder


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_those_of_the_whole_text(whole):
    tool, r = Encoder(**VOCABULARY), random.Random(1)
    letters = "a bé \n\t1'sT日 <|endoftext|>\x1c"
    texts = [t or "" for _, t in ODD] + ["".join(r.choice(letters) for _ in range(r.randint(0, 16))) for _ in range(4000)] + ["x<|endoftext|> y"]
    for t in texts:
        assert memoryview(tool.packed(t)).cast("I").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_latin_texts_are_encoded_whole_and_in_parts(whole, monkeypatch):
    class Counted:
        def __init__(self, tool):
            self.tool, self.calls = tool, 0

        def encode_ordinary(self, text):
            self.calls += 1
            return self.tool.encode_ordinary(text)

    tool, r = Encoder(**VOCABULARY), random.Random(2)
    tool.quick = Counted(tool.quick)
    letters = "abé\n\t1'sTß\xa0\x85\x1cɏ, " + " " * 6
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    ids = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [memoryview(tool.packed(t)).cast("I").tolist() for t in texts] == ids
    assert 0 < tool.quick.calls <= len(texts) and not tool.first and not tool.later
    monkeypatch.setattr("llm.tokens.PART", 5)
    assert [memoryview(tool.packed(t)).cast("I").tolist() for t in texts] == ids
    # other letters go word by word, as before
    assert memoryview(tool.packed("old 日 word")).cast("I").tolist() == whole.encode("old 日 word", add_special_tokens=False).ids
    assert len(tool.later) == 2


def test_pieces(docs, whole):
    rows = ODD + [(20, prose(5, 900))]
    got = packing.token_pieces(docs(rows), end_id=2, capacity=64, with_ids=True, **VOCABULARY).collect()
    want = []
    for i, t in rows:
        ids = ids_of(whole, t)
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            want.append((i, n, a, b - a, zlib.crc32(part), part))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == Counter(want)


def placed(spark, lengths, capacity):
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    out = packing.pack(df, capacity).collect()
    assert sorted(r.length for r in out) == sorted(lengths)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_every_piece_has_one_gapless_place(spark):
    r = random.Random(3)
    lengths = [r.choice([3, 7, 60, 100, 33, 50, 64, 1]) for _ in range(400)] + [41] * 300
    room = []  # first fit, longest first
    for n in sorted(lengths, reverse=True):
        at = next((i for i, free in enumerate(room) if free >= n), None)
        if at is None:
            room.append(100 - n)
        else:
            room[at] -= n
    assert placed(spark, lengths, 100) <= len(room)
    assert placed(spark, [60, 40, 70, 30, 50, 50], 100) == 3
    assert placed(spark, [100], 100) == 1


def test_fullest_bin_against_all_subsets():
    r = random.Random(4)
    for _ in range(200):
        capacity = r.randint(5, 40)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        counts = [lengths.count(x) for x in range(capacity + 1)]
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        totals = {0}
        for x in rest:
            totals |= {t + x for t in totals if t + x + first <= capacity}
        chosen = packing.fullest(counts, first, capacity)
        assert sum(chosen) == first + max(totals) and not Counter(chosen) - Counter(lengths)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert packing.pack(empty, 8).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)
    repeated = spark.createDataFrame([(None, 0, 4)] * 5 + [(1, 0, 4)], "doc_id long, piece int, length long")
    assert packing.pack(repeated, 8).selectExpr("count(distinct sequence_id)").first()[0] == 3


def test_sequences_hold_the_ids(docs):
    texts = [prose(i, 20 + 11 * i) for i in range(12)]
    pieces = packing.token_pieces(docs(texts), end_id=2, capacity=128, with_ids=True, **VOCABULARY)
    out = packing.sequences(packing.pack(pieces, 128)).collect()
    assert sum(len(r.ids) for r in out) == sum(len(r.ids) for r in pieces.collect()) and all(len(r.ids) <= 512 for r in out)


def test_ids_in_halves_take_less_room_and_come_back(spark, docs, tmp_path):
    r = random.Random(3)
    texts = ODD + [(i + 20, " ".join("".join(r.choices("aeioubcdklmnrst", k=6)) for _ in range(700))) for i in range(30)]
    plain, laid = (packing.token_pieces(docs(texts), end_id=2, capacity=128, with_ids=True, in_halves=p, **VOCABULARY) for p in (False, True))
    size = {}
    for name, df in (("plain", plain), ("laid", laid)):
        df.select("ids").coalesce(1).write.option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/{name}")
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    assert size["laid"] < 0.85 * size["plain"]
    found = [sorted((r.doc_id, r.piece, bytes(r.ids), r.sequence_id, r.offset) for r in packing.pack(df, 128, in_halves=column).collect())
             for df, column in ((plain, None), (laid, "ids"))]
    assert found[0] == found[1]
