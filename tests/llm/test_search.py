import random

import pytest
from tokenizers.models import Unigram

from lodestone.llm import qgram_decontam as qg
from lodestone.llm import viterbi_count as vc


def library_count(pieces, text):
    model = Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False)
    return len(model.tokenize(vc.SPACE + text.replace(" ", vc.SPACE))) if text else 0


@pytest.fixture(scope="module")
def pieces():
    return vc.vocabulary(vc.default_vocabulary())


def test_count_equals_library(spark, sf, pieces):
    low = min(s for _, s in pieces)
    model = Unigram([("<unk>", low), *pieces], unk_id=0, byte_fallback=False)
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in rows[:120]} | {-1: "  two  spaces ", -2: "日本語\x00\x01\x02 x", -3: "a\nb\tc", -4: "\x00", -5: " "}
    known = vc.Counter(pieces)
    assert known.by_word
    for doc, text in texts.items():
        assert known.count(text) == len(model.tokenize(vc.SPACE + text.replace(" ", vc.SPACE))), doc
    got = {r.doc_id: r.n_tokens for r in vc.query(spark, sf).filter("doc_id < 120").collect()}
    assert all(known.count(texts[d]) == n for d, n in got.items() if d in texts)
    assert known.count(None) == known.count("") == 0


def test_ties_and_unknowns():
    rng = random.Random(1)
    for _ in range(150):
        made = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): float(-rng.randint(1, 3)) for _ in range(6)}
        low = list(made.items())
        model = Unigram([("<unk>", min(made.values())), *low], unk_id=0, byte_fallback=False)
        text = "".join(rng.choice("abc ") for _ in range(12))
        assert vc.Counter(low).count(text) == len(model.tokenize(vc.SPACE + text.replace(" ", vc.SPACE))), (made, text)


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_planted_passages():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(12, 60))) for i in range(20)] + [(99, "short"), (98, prose(8)[:40])]
    items = [(i, t) for i, t in items if len(t) >= qg.MIN_ITEM]
    block = qg.build(items)
    texts, planted = [None, "", "x"], [set(), set(), set()]
    for k in range(120):
        i, t = rng.choice(items)
        t = list(t)
        for _ in range(k % 4 if len(t) >= 72 else 0):
            p = rng.randrange(len(t))
            t[p : p + rng.randint(0, 1)] = rng.choice(["", "z", "Q"])
        t = "".join(t)
        texts.append(prose(rng.randint(0, 50)) + " " + (t.upper().replace("ß", "ß") if k % 5 == 0 else t) + " " + prose(rng.randint(0, 50)))
        planted.append({i})
    texts += [prose(200) for _ in range(30)]
    planted += [set()] * 30
    for text, want, hits in zip(texts, planted, qg.search(texts, block)):
        assert {h[0] for h in hits} == want
    # no window within its edits is missed, none beyond them is reported
    for text in texts[3:15]:
        folded = qg.fold(text)
        want = {items[w.item][0] for w in block.windows if distance_in(w.text, folded) <= w.edits}
        assert {h[0] for h in next(qg.search([text], block))} == want


def test_decontamination_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in qg.query(spark, sf).collect()}
    assert set(got) == set(docs)
    for doc, text in docs.items():
        exact = {i for i, t in items.items() if t in text}
        assert exact <= got[doc]
        for i in got[doc] - exact:  # near ones share at least a long stretch
            t, folded = qg.fold(items[i]), qg.fold(text)
            assert any(t[a : a + qg.Q] in folded for a in range(len(t) - qg.Q))


def test_blocks_and_odd_rows(spark, monkeypatch):
    passage = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood again"
    bench = spark.createDataFrame([(1, passage), (2, None), (3, passage), (4, "tiny"), (None, passage[::-1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage} y", "a"), (1, f"x {passage} y", "a"), (2, None, "b"), (None, passage[::-1], "c"), (3, "", None)], "doc_id long, text string, item_id string")
    want = [(None, [(None, 0)]), (1, [(1, 2), (3, 2)]), (1, [(1, 2), (3, 2)]), (2, []), (3, [])]
    for size in (2_000_000, 50):
        monkeypatch.setattr(qg, "BLOCK_CHARS", size)
        rows = qg.find_regions(docs, bench).collect()
        key = lambda x: (x[0] is not None, x[0] or 0, str(x[1]))
        got = sorted(((r.doc_id, sorted([(h.item_id, h.start) for h in r.regions])) for r in rows), key=key)
        assert got == sorted(want, key=key)
    assert qg.find_regions(docs, bench.limit(0)).filter("size(regions) > 0").count() == 0
    assert qg.find_regions(docs.limit(0), bench).count() == 0
