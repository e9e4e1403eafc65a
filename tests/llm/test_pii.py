import hashlib
import re

import pytest

from lodestone.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def expected(text):
    text = text or ""
    spans = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return spans


HARD = [
    None, "", "a@b.c_d@e.f x@y@z.com", "1.2.3.4.5.6.7.8 1.2..3.4.5.6 0001.02.255.255 256.1.1.1 300.1.2.3.4", "4111 1111-1111 1111 4111111111111112 +1 (314) 555-6532", "é\U0001f600 me@x.org\x01you@y.net", "+1((((( +123456789 +1-2",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "call 314-555-6532 or 314-555-6533x", "ssn 123-45-6789", "123-45-6789", "a" * 50000 + " " + "1" * 50000 + "@", "a@b" + ".c" * 20000, "7 " * 20000, "x@y.zz " * 3000, "5-" * 9 + "é +12 34 56 78 90",
]


@pytest.fixture(scope="module")
def cases(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows} | {10_000 + i: t for i, t in enumerate(HARD)}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_base_spans(cases):
    texts, docs = cases
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    for doc, text in texts.items():
        got = [(s.kind, s.start, s.end) for k in ("email", "ip", "card", "phone") for s in found[doc][k]]
        assert got == expected(text), doc


def test_query_digest(spark, sf):
    rows = {r.doc_id: r for r in pii.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = expected(r.text)
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got.spans.startswith(want)
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


def test_further_kinds(cases):
    _, docs = cases
    found = {r.doc_id - 10_000: r for r in pii.find(docs).collect()}
    assert [(s.start, s.end) for s in found[HARD.index(next(t for t in HARD if t and t.startswith("IBAN")))].iban] == [(5, 32)]
    assert len(found[8].localtel) == 1  # context words count up to the next span of the kind
    assert len(found[9].idnum) == 1 and len(found[10].idnum) == 0


IBANS = [
    ("IBAN DE89370400440532013000 Please pay", [(5, 27)]),
    ("DE89 3704 0044 0532 0130 00 Bitte", [(0, 27)]),
    ("IBAN GB82WEST12345698765432 BIC ABCD", [(5, 27)]),
    ("DE89370400440532013000 20 euro", [(0, 22)]),
    ("NO93 8601 1117 947 OSLO 12, MT84MALT011000012345MTLCAST001S X", [(0, 18), (28, 59)]),
    ("ZZ12 DE89370400440532013000 GB82WEST12345698765432", [(5, 27), (28, 50)]),
    ("DE89370400440532013000X DE88370400440532013000 A XDE89370400440532013000", []),
    ("QX52" + "A" * 14, [(0, 18)]),
]


def test_numbers_end_with_their_countrys_length(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(IBANS)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.iban] for r in pii.find(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(IBANS)}


def test_masked(spark):
    docs = spark.createDataFrame([(1, "to me@x.org, +1 (314) 555-6532!"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.masked(docs).collect()} == {1: "to <EMAIL>, <PHONE>!", 2: ""}


def test_empty(spark, cases):
    assert pii.find(cases[1].limit(0)).count() == 0
