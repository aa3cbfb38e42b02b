import re

import pytest
from pyspark.sql import functions as F
from tests_llm_common import ODD

from llm import pseudonyms
from llm.feistel import permuted


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations_are_one_to_one_and_undone(spark, n):
    df = spark.range(n).withColumn("y", permuted(F.col("id"), n, "k", "t")).withColumn("z", permuted(F.col("y"), n, "k", "t", back=True))
    got = df.collect()
    assert sorted(r.y for r in got) == list(range(n)) and all(r.z == r.id for r in got)


def run(docs, rows, key="k", back=False):
    return {r.doc_id: r for r in pseudonyms.pseudonymised(docs(rows), key, back=back).collect()}


TEXTS = ["card 4111 1111 1111 1111, again 4111-1111-1111-1111 and 4111111111111111.", "call +1 (632) 555-4827 or 632-555-4827!",
         "ssn 123-45-6789", "host 192.168.10.7 and 10.0.0.255", "born 1987-06-05, 05.06.1987, 06/05/1987",
         "no 4111111111111112, 2024-13-45, 31.02.2020, 300.1.1.1, 000-12-3456, 666-12-3456, 555-4827, 12345, v1.2.3.4.5, x4111111111111111"]


def test_formats_stay_and_values_stay_linked(docs):
    got = run(docs, TEXTS)
    out = {i: r.pseudonymised for i, r in got.items()}
    assert all(len(out[i]) == len(TEXTS[i]) for i in (0, 1, 2, 4))
    cards = re.findall(r"\d(?:[ -]?\d){15}", out[0])
    assert len(cards) == 3 and all(map(luhn, cards)) and len({re.sub(r"\D", "", c) for c in cards}) == 1
    assert re.sub(r"\D", "", cards[0]) != "4111111111111111" and got[0].n_card == 3
    phones = re.findall(r"\d{3}\D{1,2}\d{3}-\d{4}", out[1])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and out[1].startswith("call +1 (")
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", out[2]) and out[2] != TEXTS[2]
    assert all(0 <= int(x) < 256 for x in re.findall(r"\d+", out[3])) and got[3].n_ip == 2
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", out[4]).groups()
    assert f"{d}.{m}.{y}" in out[4] and f"{m}/{d}/{y}" in out[4]
    assert out[5] == TEXTS[5]  # nothing there is valid


def test_round_trip_and_keys(docs):
    out = [r.pseudonymised for _, r in sorted(run(docs, TEXTS).items())]
    back = [r.pseudonymised for _, r in sorted(run(docs, out, back=True).items())]
    other = [r.pseudonymised for _, r in sorted(run(docs, TEXTS, key="other").items())]
    assert back == TEXTS and other[:5] != out[:5]


def test_odd_rows(docs):
    rows = [(i, t) for i, t in ODD if i is not None and i != 5]
    got = run(docs, rows)
    assert {i: r.pseudonymised for i, r in got.items()} == dict(rows)
    assert all(r[f"n_{k}"] == 0 for r in got.values() for k in pseudonyms.PATTERNS)
    assert run(docs, []) == {}
    with pytest.raises(ValueError):
        pseudonyms.pseudonymised(docs([]).withColumn("n_ip", F.lit(1)), "k")


def test_many_values_in_one_text(docs):
    text = " ".join(f"10.{i // 250}.{i % 250}.1" for i in range(1500))
    out = run(docs, [text])[0].pseudonymised.split(" ")
    assert len(set(out)) == 1500


HIDDEN = {
    "phone": ["+1 (017) 555-7713", "+1 (132) 555-1352", "212 555 0100", "2125550100", "tel:632-555-4827", "12/632.555.4827"],
    "abroad": ["+44 20 7946 0958", "+49 (30) 901820", "+33123456789"],
    "card": ["4111 1111 1111 1111 123", "12 4111111111111111", "1234 4111 1111 1111 1111", "card:4111111111111111", "4111-1111-1111-1111 12ab"],
    "ssn": ["ssn:123-45-6789", "SSN/123-45-6789"],
    "ip": ["10.1.2.3:8080", "http://10.1.2.3/x", "ip-10.1.2.3"],
    "iso_date": ["1987-06-05T10:00", "on:1987-06-05"],
    "slashed_date": ["25/12/1987", "13/01/2001", "05/06/1987"],
}


def test_other_spellings_and_neighbours(docs):
    rows = [(kind, text) for kind, texts in HIDDEN.items() for text in texts]
    got = run(docs, [t for _, t in rows])
    for i, (kind, text) in enumerate(rows):
        new, digits = got[i].pseudonymised, "[0-9]+" if kind == "ip" else "[0-9]"
        assert got[i][f"n_{kind}"] == 1 and new != text and re.sub(digits, "0", new) == re.sub(digits, "0", text), (text, new)
    back = run(docs, [got[i].pseudonymised for i in range(len(rows))], back=True)
    assert [back[i].pseudonymised for i in range(len(rows))] == [t for _, t in rows]


def test_rows_of_groups_are_undone(docs):
    texts = [f"{i} 4111 1111 1111 1111 {7 * i:03d}" for i in range(60)] + ["4111111111111111 5500005555555559", "1 " * 5000]
    got = run(docs, texts)
    assert all(got[i].n_card >= 1 for i in range(60)) and got[60].n_card == 2
    back = run(docs, [got[i].pseudonymised for i in range(len(texts))], back=True)
    assert [back[i].pseudonymised for i in range(len(texts))] == texts


SPELLINGS = {  # one value in many spellings, alone and next to other numbers
    "card": ["30569309025904", "3056 930902 5904", "3056-930902-5904", "id 30569309025904.", "77 3056 930902 5904", "30569309025904 2024-01-15",
             "3056 930902 5904 632-555-4827"],
    "card15": ["378282246310005", "3782 822463 10005", "3782-822463-10005", "12 3782 822463 10005"],
    "card13": ["4222222222222", "4222 222 222 222", "4222-222-222-222"],
    "phone": ["632-555-4827", "+1 (632) 555-4827", "6325554827", "632.555.4827", "call 632 555 4827 99"],
    "date": ["1987-06-25", "25.06.1987", "25/06/1987", "06/25/1987"],
}


def values(name, text):
    """The digits of the value in a spelling; a date as yyyymmdd."""
    if name == "date":
        a, b, c = re.split(r"[-./]", text)
        return a + b + c if "-" in text else c + (b + a if int(a) > 12 else a + b)
    n = {"card": 14, "card15": 15, "card13": 13, "phone": 10}[name]
    return {re.sub(r"[^0-9]", "", text)[i:i + n] for i in range(40)}


def test_every_spelling_of_a_value_has_one_pseudonym(docs):
    rows = [(name, text) for name, texts in SPELLINGS.items() for text in texts]
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs([t for _, t in rows]), "k", reversible=False).collect()}
    for name in SPELLINGS:
        out = [got[i].pseudonymised for i, (n, _) in enumerate(rows) if n == name]
        want = values(name, out[0])
        if name == "date":
            assert {values(name, t) for t in out} == {want} and want != "19870625"
            continue
        (value,) = [v for v in want if len(v) == {"card": 14, "card15": 15, "card13": 13, "phone": 10}[name]]
        assert all(value in values(name, t) for t in out), (name, out)
        assert name == "phone" or luhn(value)
    assert all(got[i].n_card == 1 and got[i].n_phone == ("632" in t) for i, (n, t) in enumerate(rows) if n.startswith("card"))


def test_no_pseudonym_is_read_by_another_format(docs):
    """Cards in 4-6-4 groups, whose tails look like phone numbers: one replacement each, undone by the key."""
    cards = []
    for i in range(200):
        body = f"30{i * 7919 % 10**11:011d}"
        cards.append(next(body + c for c in "0123456789" if luhn(body + c)))
    texts = [f"{c[:4]} {c[4:10]} {c[10:]}" for c in cards]
    got = run(docs, texts + cards)
    for i, c in enumerate(cards):
        spaced, plain = got[i], got[i + 200]
        assert (spaced.n_card, spaced.n_phone, plain.n_card, plain.n_phone) == (1, 0, 1, 0)
        assert spaced.pseudonymised.replace(" ", "") == plain.pseudonymised and luhn(plain.pseudonymised) and plain.pseudonymised != c
    back = run(docs, [got[i].pseudonymised for i in range(400)], back=True)
    assert [back[i].pseudonymised for i in range(400)] == texts + cards


def test_the_marks_of_the_method_may_be_in_a_text(docs):
    marks = "".join(chr(0xFDD0 + i) for i in range(32))
    texts = [marks + " 10.0.0.255 " + marks[::-1] + marks[10] * 3 + marks[11] + marks[21], marks]
    got = run(docs, texts)
    assert got[0].n_ip == 1 and got[0].pseudonymised.startswith(marks + " ") and got[0].pseudonymised.endswith(texts[0].split("255 ")[1])
    assert got[1].pseudonymised == marks and run(docs, [got[0].pseudonymised], back=True)[0].pseudonymised == texts[0]
