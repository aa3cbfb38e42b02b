import zlib

import numpy as np
import public_tokenizers as P
from tests_llm_common import ODD, prose
from tokenizers import Tokenizer

from llm import training_order as order
from llm.common import shared_folder
from llm.queries import QUERIES, SEQUENCE, VOCABULARY


def materialise(spark, df, stride=32, records=8):
    path = shared_folder(spark, "test-shards")
    rows = order.token_sequences(df, ["doc_id"], "text", stride, 2, **VOCABULARY)
    return path, order.write_shards(order.ordered(rows, ["doc_id", "piece"], "k"), path, stride, records).collect()


def test_round_trip(spark, docs):
    texts = [prose(i, 10 + 7 * i) for i in range(25)]
    path, rows = materialise(spark, docs(texts))
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and all(r.shard == r.slot // 8 and r.position == r.slot % 8 * 128 for r in rows)
    records = list(order.read_slots(path, 32, 8, 0, n + 5))
    assert len(records) == n
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = records[r.slot][: r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and not records[r.slot][r.length:].any()
        found.setdefault(r.doc_id, []).extend(ids.tolist())
    assert found == {i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    # resumed in the middle of a shard
    assert all(np.array_equal(a, b) for a, b in zip(order.read_slots(path, 32, 8, 11, 9), records[11:20]))


def test_order_is_keyed_and_repeatable(spark, docs):
    df = docs([prose(i, 5) for i in range(200)])
    a = {(r.doc_id, r.piece): r.slot for r in materialise(spark, df)[1]}
    b = {(r.doc_id, r.piece): r.slot for r in materialise(spark, df.repartition(4))[1]}
    assert a == b and abs(np.corrcoef([k[0] for k in a], list(a.values()))[0, 1]) < 0.3


def test_odd_rows(spark, docs):
    _, rows = materialise(spark, docs([r for r in ODD if r[1] is None or len(r[1]) < 5000]))
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert materialise(spark, docs([]))[1] == []


def test_query_covers_every_document(spark, docs, tmp_path):
    texts = [prose(i, 20) for i in range(30)] + [prose(77, 3 * SEQUENCE), None]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    docs(texts).selectExpr("doc_id as conv_id", "cast(0 as int) as turn", "'user' as role", "'hi' as text").limit(2).write.parquet(
        f"{tmp_path}/conversations.parquet")
    rows = QUERIES["op9_training_order"](spark, str(tmp_path)).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    length = {}
    for r in rows:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert length == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
