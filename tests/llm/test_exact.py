import hashlib
import re

from tests_llm_common import ODD, prose
from llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return out, groups


def check(docs, rows):
    want, groups = brute(rows)
    got = exact_dedup.exact_groups(docs(rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows(docs):
    check(docs, ODD)


def test_hot_text_over_many_slots(docs):
    check(docs, [(i, "the  same\ttext" if i % 3 else prose(i, 5)) for i in range(900)])


def test_drop_keeps_columns_and_one_row_a_text(docs):
    got = exact_dedup.drop_exact(docs(ODD))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i in (1, 3, 4, 5, 6, None, 7, 9, -3))


def test_empty_table_and_other_names(docs, spark):
    assert exact_dedup.exact_groups(docs([])).collect() == []
    other = spark.createDataFrame([(2, "a", 1, "x"), (1, "a", 2, "y")], "id int, body string, keep_id int, text_sha256 string")
    assert {(r.id, r.keep_id) for r in exact_dedup.exact_groups(other, "id", "body").collect()} == {(1, 1), (2, 1)}
