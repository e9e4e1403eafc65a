import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import fuzzy_lines, jaccard_join, linking, textblocks

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(sets):
    """Brute force over the keys that two sets share."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in sets.items():
        seen = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice("qrstuvwxyz") * rng.randint(1, 9)
    return words


def made_docs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts, passage = [None, "", " \n", "One", "one", "one\ttwo three", "a b c d", "a b c d e", "A B c d E"], [word() for _ in range(60)]
    for k in range(40):
        base = [word() for _ in range(rng.choice((4, 5, 6, 8, 9, 10, 14, 20, 25, 40, 80, 150, 400)))]
        texts += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 40)))) for _ in range(rng.choice((1, 2, 3, 8)))]
        chain = base
        for _ in range(5):
            chain = edited(rng, chain, max(1, len(base) // 60))
            texts.append(" ".join(chain))
        texts.append(" ".join(base + passage))
    texts += [f"{k} " + " ".join(passage) for k in range(30)]
    return dict(enumerate(texts))


def groups(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    named, _ = jaccard_join.join(docs)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in named.collect()}


@pytest.mark.parametrize("boundary", [None, 0, 60])
def test_join_equals_brute_force(spark, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda _: boundary)
    texts = made_docs()
    want = {i: shingles(t) for i, t in texts.items()}
    found = components({i: s for i, s in want.items() if s})
    assert groups(spark, texts) == {i: (len(s), found.get(i, i)) for i, s in want.items()}


def test_join_on_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: shingles(t) for i, t in texts.items()}
    found = components({i: s for i, s in want.items() if s})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.query(spark, sf).collect()}
    assert got == {i: (len(s), found.get(i, i)) for i, s in want.items()}


def test_long_texts_in_parts(monkeypatch):
    texts = [" ".join(str(i % 97) for i in range(3000)), "a b c d e f", None, "x", " " * 500 + "p q r s t u v"]
    whole = [(r, s.tolist()) for r, s in jaccard_join.shingle_sets(pa.array(texts))]
    parts = [(r, s.tolist()) for r, s in _with_blocks(texts, 64)]
    assert whole == parts and [len(s) for _, s in whole] == [len(shingles(t)) for t in texts]


def _with_blocks(texts, limit):
    blocks = textblocks.blocks
    try:
        jaccard_join.blocks = lambda column: blocks(column, limit)
        return list(jaccard_join.shingle_sets(pa.array(texts)))
    finally:
        jaccard_join.blocks = blocks


def test_odd_tables(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (5, "a b c d e f g"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as key", "3 as component")
    named = jaccard_join.join(docs)[0].collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in named) == [(0, 3), (3, 3), (5, 3), (5, 3), (7, 7)]
    assert jaccard_join.join(docs.limit(0))[0].count() == 0
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 7]


def test_null_and_repeated_ids_lose_no_text(spark):
    """The middle of a chain has no doc_id; one doc_id has many texts, each with a near copy of its own."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    chain = [[word() for _ in range(100)]]
    for k in (20, 60):
        chain.append([*chain[-1][:k], word(), *chain[-1][k + 1 :]])
    chain[1], chain[0] = chain[0], [*chain[0][:5], *(word() for _ in range(2)), *chain[0][7:]]
    rows = [(1, " ".join(chain[0])), (None, " ".join(chain[1])), (2, " ".join(chain[2]))]
    for k in range(20):
        own = [word() for _ in range(100)]
        rows += [(50, " ".join(own)), (100 + k, " ".join([*own[:50], word(), *own[51:]]))]
    sets = {i: shingles(t) for i, (_, t) in enumerate(rows)}
    parts, want = components(sets), {}
    for i, c in parts.items():
        want.setdefault(c, []).append(rows[i][0])
    assert sorted(map(len, want.values())) == [2] * 20 + [3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id or 0, r.component_id) for r in jaccard_join.join(docs)[0].collect()]
    assert sorted(got) == sorted([(0, 1), (1, 1), (2, 1)] + [(50, 50)] * 20 + [(100 + k, 50) for k in range(20)])
    docs = spark.createDataFrame([(1, rows[3][1]), (9, rows[4][1]), (9, rows[5][1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard_join.stage(spark, docs, "").collect()) == sorted([(1, rows[3][1]), (9, rows[5][1])])


def test_lists_across_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(n)) for k, n in zip(rng.integers(0, 2500, 5000), rng.integers(0, 300, 5000))]
    want = {}
    for k, n in rows:
        want.setdefault(k, set()).add(n)
    want = {(k, n) for k, v in want.items() if len(v) > 1 for n in v}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = linking.shared_lists(spark.createDataFrame(rows, "key long, node long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r.key, r.node) for r in got} == want


def line_groups(docs):
    """(doc_id, text, line_no) -> whether the line goes, by brute force."""
    rows = sorted({(d, t) for d, t in docs if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    coordinates = [(d, t, n, x.strip(" \t\r\v\f")) for d, t in rows for n, x in enumerate(t.split("\n"))]
    coordinates = [c for c in coordinates if len(c[3]) >= fuzzy_lines.MIN_CHARS]
    lines = sorted({c[3] for c in coordinates})
    part = components({i: set(fuzzy_lines.shingles(x)) for i, x in enumerate(lines)})
    number = {x: part[i] for i, x in enumerate(lines)}
    kept, lost = set(), {}
    for d, t, n, x in coordinates:
        if number[x] in kept:
            lost.setdefault(d, []).append(n)
        kept.add(number[x])
    return lost


def test_lines_on_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.removed for r in fuzzy_lines.query(spark, sf).collect()}
    want = line_groups(docs)
    assert {d: n for d, n in got.items() if n} == want and len(got) == len(docs)


def test_repetitive_lines_and_bounds(spark):
    """Sets, not lengths, are compared; the bitmap bound drops no link."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    texts = ["abcabcabc" * n for n in (4, 9, 30)] + [" ".join(edited(rng, words, rng.randint(0, 3))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in fuzzy_lines.duplicates(frame).collect()}
    assert got == line_groups(docs)


LINES = [
    (1, "The first line of the first document\nshort\n\nAnother line that is here only once, it seems"),
    (2, "the FIRST line of the first document \nshort\nNothing like any other line of these documents"),
    (3, None), (None, "x"), (4, ""), (5, "The first line of the first document"), (6, "日本語の長い行がここにあります。日本語の長い行\n\U0001f600" + "é" * 30), (7, "日本語の長い行がここにあります。日本語の長い行"),
]


def test_line_stage(spark):
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in LINES], "doc_id long, text string, n_chars long").selectExpr("*", "'z' as line", "1 as node")
    done = fuzzy_lines.stage(spark, docs, "")
    assert done.columns == docs.columns
    got = {r.doc_id: r for r in done.collect()}
    assert got[2].text == "Nothing like any other line of these documents" and got[2].n_chars == len(got[2].text)
    assert got[1].text == LINES[0][1] and 5 not in got and 7 not in got
    assert got[3].text is None and got[None].text == "x" and got[4].text == ""
    assert fuzzy_lines.stage(spark, docs.limit(0), "").count() == 0


def test_short_lines_take_part(spark):
    texts = ["Menu\n\nx\n \nOne line that is here only once", "menu\nx\nMenus\ny", "Les.\nx", " Les. \n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.removed for r in fuzzy_lines.duplicates(docs).collect()} == {1: [0, 1], 2: [1], 3: [0]}


def test_one_edit_in_short_lines(spark):
    """Planted in lines of 53 to 77 characters, one changed character links; so does one changed word in 89 to 107."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    lines = []
    for k in range(40):
        own = [word() for _ in range(rng.randint(9, 13) if k % 2 else rng.randint(15, 18))]
        at = len(own) // 2
        changed = own[at][:2] + "7" + own[at][3:] if k % 2 else word()
        lines += [" ".join(own), " ".join([*own[:at], changed, *own[at + 1 :]])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    lost = {r.doc_id for r in fuzzy_lines.duplicates(docs).collect()}
    assert lost == set(range(1, 80, 2))


def test_recall_of_bands():
    rng = random.Random(8)
    missed = total = 0
    for _ in range(300):
        base = [rng.choice("abcdefghijklmnop") for _ in range(150)]
        other = list(base)
        other[rng.randrange(20, 130)] = "z"
        a, b = "".join(base), "".join(other)
        x, y = fuzzy_lines.shingles(a), fuzzy_lines.shingles(b)
        if len(x & y) / len(x | y) >= 0.8:
            keys = fuzzy_lines.signatures([a, b])
            total += 1
            missed += not (keys[0] == keys[1]).any()
    assert total > 200 and missed <= 2
