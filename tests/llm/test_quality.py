import random
import re

import numpy as np
import pytest

from lodestone.llm import divergence, rff_classifier

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


ODD = [None, "", "a\x1cb\x85c d\xa0e", "x\n\nx\n \nx", "a b c d e f a b c d e", "a a a a a a", "日本 語 \U0001f600 #" * 40, "w " * 30000, "a b c d e a b c d", "1 2 3 4 5 6 7 8 9"]


def test_base_rules(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-i - 1, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in divergence.judge(docs, divergence.References({}, {}, {})).collect()}
    for doc, text in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), doc
        assert r.kept == (not r.base_failed)


def test_references_are_exact_counts(spark):
    docs = spark.createDataFrame([("to be or not to be", "en"), ("sein oder nicht sein", "de"), (None, "en"), ("to", None)], "text string, lang string")
    known = divergence.references(docs)
    assert known.words["en"][b"be"] == 0 and known.counts["en"].tolist() == [2, 2, 1, 1, 0]
    assert set(known.words) == {"en", "de", ""}
    assert known.characters["en"].sum() == 18


def test_divergence_keeps_clean_and_drops_junk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = divergence.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in found if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert divergence.judge(docs.limit(0), divergence.references(docs.limit(0))).count() == 0


def clean_labels(n):
    """A text of 60 of its own 20 words and characters for each of n labels; the last label is the smallest."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        own = ["".join(rng.choice(letters) for _ in range(6)) + str(k) for _ in range(20)]
        rows += [(len(rows) + i, " ".join(rng.choice(own) for _ in range(60)), f"l{k:03}") for i in range(3 if k < n - 1 else 1)]
    return rows


def test_every_label_has_a_reference(spark, monkeypatch):
    rows = clean_labels(70)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(divergence.references(docs).words) == 70
    whole = {r.doc_id: r for r in divergence.judge(docs, divergence.reference_blocks(docs)).collect()}
    assert len(whole) == len(rows) and all(r.kept for r in whole.values())
    monkeypatch.setattr(divergence, "BLOCK", 16)
    assert len(list(divergence.reference_blocks(docs))) == 5
    assert {r.doc_id: r for r in divergence.judge(docs, divergence.reference_blocks(docs)).collect()} == whole


def test_counts_are_summed_over_partitions(spark):
    """Words that are rare in each chunk count, and those rare in one chunk only keep what they have there."""
    rich = " ".join(f"w{i}" for i in range(3000))
    rows = [(rich, "a"), ("w7 w7", "a"), ("common " + " ".join(f"v{i}" for i in range(3000)), "a"), ("common " * 5, "a")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    known = divergence.references(docs)
    assert list(known.words["a"])[:2] == [b"common", b"w7"] and len(known.words["a"]) == divergence.COMMON
    assert known.counts["a"][:3].tolist() == [6, 3, 1] and known.counts["a"].sum() == 3000 + 2 + 3001 + 5


def test_nearest_equals_plain_distances():
    rng = random.Random(5)
    known = divergence.References({}, {}, {})
    for k in range(9):
        counts = np.array([rng.randint(1, 50) for _ in range(k)] + [rng.randint(0, 90)], float)
        known.words[str(k)] = {b"%d" % w: i for i, w in enumerate(rng.sample(range(30), k))}
        known.counts[str(k)] = counts
        known.characters[str(k)] = np.array([rng.randint(0, 40) for _ in divergence.CLASSES], float) * (k > 0)
    nearest = divergence.Nearest(known)
    for _ in range(50):
        words = [b"%d" % rng.randrange(40) for _ in range(rng.randint(1, 80))]
        want = []
        for k, numbers in known.words.items():
            p = np.array([words.count(w) for w in numbers] + [sum(w not in numbers for w in words)], float)
            want.append(divergence.distance(p, known.counts[k]))
        assert nearest.word_distance(words) == pytest.approx(min(want), abs=1e-7)
        classes = np.array([rng.randint(0, 9) for _ in divergence.CLASSES])
        assert nearest.character_distance(classes) == pytest.approx(min(divergence.distance(classes, q) for q in known.characters.values()), abs=1e-7)


def test_distance():
    assert divergence.distance(np.array([1, 0]), np.array([0, 5])) == 1.0
    assert divergence.distance(np.array([1, 3]), np.array([2, 6])) == 0.0


def test_pool_is_isotonic():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 9, 50)
    k = np.array([rng.integers(0, x + 1) for x in n])
    knots, values = rff_classifier.pool(n, k, np.arange(50.0))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    x = values[np.searchsorted(knots, np.arange(50)).clip(0, len(values) - 1)]
    assert 0 <= x.min() and x.max() <= 1


@pytest.fixture(scope="module")
def scored(spark, sf):
    return rff_classifier.query(spark, sf.replace("sf0.001", "sf0.01"))


def test_held_out_accuracy(spark, sf, scored):
    rows = scored.join(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) and len(rows) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_learns_nothing_from_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = ({r.doc_id: r.score for r in rff_classifier.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, " \n")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    rows = rff_classifier.classify(docs, none).collect()
    assert len(rows) == 4 and all(r.score == 0.5 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert rff_classifier.classify(docs.limit(0), none).count() == 0
