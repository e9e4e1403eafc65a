"""Cases that every operator and stage must define: nulls, empty and very long texts, repeats, clashing columns."""

import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import bin_packing, divergence, fuzzy_lines, jaccard_join, linking, pii, rff_classifier, url_filter
from lodestone.llm import qgram_decontam as qg
from lodestone.llm import queries as llm_queries
from lodestone.llm import viterbi_count as vc


def distance_in(pattern, text):
    """The least edits between pattern and a part of text, a row of the table at a time."""
    row = np.zeros(len(text) + 1, np.int64)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(pattern, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        new = np.append(i, new)
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def near(rng, words):
    words = list(words)
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


# --- q-grams


def test_repetitive_texts_stay_small():
    block = qg.build([(1, "=" * 100), (2, "=-" * 200), (3, "the quick brown fox jumps over the lazy dog and runs " * 3)])
    assert len(block.windows) < 40
    long = "=" * 400_000
    (hits,) = qg.search(["x" + long + "y"], block)
    assert [h[:3] for h in hits] == [(1, 1, 400_001)]  # one region, whose ends also match with edits
    (hits,) = qg.search(["=-" * 30_000], block)
    assert {h[0] for h in hits} == {2} and hits[0][1] == 0 and hits[-1][2] >= 59_999


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg ") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(12)]
    text = " ".join(" ".join(word() for _ in range(40)) + " " + t for _, t in items)
    block = qg.build(items)
    whole = list(qg.search([text, None, text[100:]], block))
    assert {h[0] for h in whole[0]} == set(range(12))
    for group, pairs in ((300, 1 << 21), (1 << 20, 50), (701, 1)):
        monkeypatch.setattr(qg, "GROUP", group)
        monkeypatch.setattr(qg, "PAIRS", pairs)
        assert list(qg.search([text, None, text[100:]], block)) == whole


def test_alignment_equals_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 72)))
        region = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) + "".join(c for c in pattern if rng.random() > 0.03) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        best = distance_in(pattern, region) if region else len(pattern)
        for edits in (0, 2, 4):
            got = qg.align(pattern, region, edits)
            assert (got and got[0]) == (best if best <= edits else None)


def test_short_items():
    block = qg.build([(1, "What is the capital of France?"), (2, "Yes it is"), (3, "  "), (4, "capital of France")])
    texts = ["so WHAT is the capital of france? yes it is", "capital of Frances", "what is the capital  of France?", "yes it isn't; (Yes it is)", None]
    assert [[h[0] for h in hits] for hits in qg.search(texts, block)] == [[1, 4], [], [], [], []]
    assert [qg.weak_items(t, block) for t in texts] == [[2], [], [], [2], []]


def test_search_finds_what_windows_match(spark, sf):
    """Every window of every item against sampled whole documents, near matches included."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(40).collect()]
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    for k in range(20):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(len(t))] = rng.choice(["", "q", "zz"])
        texts.append(texts[k][:300] + " " + "".join(t) + " " + texts[k][300:500])
    block = qg.build(items)
    for text, hits in zip(texts, qg.search(texts, block)):
        folded = qg.fold(text)[:3000]
        want = {block.ids[k] for w in block.windows if distance_in(w.text, folded) <= w.edits for k in w.uses}
        assert want <= {h[0] for h in hits}
        if len(text) <= 3000:
            assert want == {h[0] for h in hits}


def test_decontamination_stage(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(5)]
    spark.createDataFrame([*enumerate(passages), (9, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"before {p} after", 1) for k, p in enumerate(passages)] + [(10, "clean words only", 2), (None, None, 3), (11, "", 4), (11, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").selectExpr("*", "'x' as regions", "1 as _id")
    for size in (2_000_000, 100):
        monkeypatch.setattr(qg, "BLOCK_CHARS", size)
        kept = qg.stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [2, 3, 4, 4]


# --- classifier


def plain_features(x, model):
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    out = np.ones((len(x), rff_classifier.COS + 1))
    for k in range(rff_classifier.COS):
        out[:, k] = (2 / rff_classifier.COS) ** 0.5 * np.cos((z * model.frequencies[:, k]).sum(1) + model.phases[k])
    return out


def test_weights_and_calibration_equal_plain_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = rff_classifier.features(docs)
    model = rff_classifier.train(stats, labels)
    taught = stats.join(labels.select("doc_id", "quality"), "doc_id").selectExpr("*", "crc32(cast(doc_id as string)) % 3 = 1 as out", "pmod(xxhash64(doc_id, 'calibrate'), 4) = 0 as late").filter("not out").collect()
    x, y, late = np.array([r.stats for r in taught]), np.array([r.quality for r in taught], float), np.array([r.late for r in taught])
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) == 0, 1, x.std(0)))
    z = plain_features(x, model)
    a, b = z[~late], y[~late]
    assert np.allclose(a.T @ (a @ model.weights - b) + rff_classifier.RIDGE * len(b) * model.weights, 0, atol=1e-6)  # the ridge optimum
    assert z.shape[1] == len(model.weights)
    # calibration: blocks of the binned raw scores whose shares rise, each the mean of its rows
    width = (rff_classifier.HIGH - rff_classifier.LOW) / rff_classifier.BINS
    bins = np.clip(((z[late] @ model.weights) - rff_classifier.LOW) / width, 0, rff_classifier.BINS - 1).astype(int)
    order = np.argsort(bins, kind="stable")
    ys, ks = y[late][order], bins[order]
    fitted = [max(min(ys[np.searchsorted(ks, lo) : np.searchsorted(ks, hi, "right")].mean() for hi in ks[ks >= k]) for lo in ks[ks <= k]) for k in ks]  # max-min formula
    centres = rff_classifier.LOW + (ks + 0.5) * width
    for value in np.unique(fitted):
        own = np.array(fitted) == value
        assert model.values[np.argmin(abs(model.knots - centres[own].mean()))] == pytest.approx(value)


def test_classifier_stage_and_long_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'z' as stats", "1 as label")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = rff_classifier.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in rff_classifier.classify(docs, labels).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in scores.items() if s >= 0.5}
    text = "word " * 400_000
    assert rff_classifier.statistics(text)[1] == pytest.approx(np.log1p(400_000))
    tail = rff_classifier.statistics("plain words here " * 30 + "# # # #")  # the last words count
    assert tail[rff_classifier.STATISTICS.index("worst_symbols")] == pytest.approx(4 / 64)


# --- near copies


def test_line_stage_with_clashing_columns(spark):
    line = "A line that stands in two documents, word for word"
    docs = spark.createDataFrame([(1, line, 5), (2, f"{line}\nAnd another one that is nowhere else", 7), (2, f"{line}\nAnd another one that is nowhere else", 7), (3, line, 9)], "doc_id long, text string, n_chars int")
    docs = docs.selectExpr("*", "'h' as _hash", "'r' as _removed", "1 as _lost_id", "2 as _lost_text", "true as _changed", "3 as component", "4 as lines", "5 as line_no", "6 as text_hash")
    done = fuzzy_lines.stage(spark, docs, "")
    assert done.columns == docs.columns and done.dtypes == docs.dtypes
    rows = sorted((r.doc_id, r.text, r.n_chars) for r in done.collect())
    other = "And another one that is nowhere else"
    assert rows == [(1, line, 5), (2, other, len(other)), (2, other, len(other))]


def test_jaccard_stage_keeps_one_row(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(90)]
    a, b = " ".join(words), near(rng, words)
    rows = [(1, a), (1, a), (2, a), (1, b), (3, b), (4, "alone in the world of words"), (4, "alone in the world of words"), (5, ""), (5, ""), (6, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _id", "2 as _text", "3 as _own", "4 as component_id", "5 as text_hash")
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text in (a, b)) for r in kept.collect())
    assert got == [(0, True), (1, True), (4, False), (5, False), (5, False), (6, False)]


def test_families_that_do_not_resemble_their_leader(spark, monkeypatch):
    """Long chains, dense families and lists over several blocks; components equal brute force."""
    from tests.llm.test_near import components, shingles

    rng = random.Random(17)
    texts = []
    for k in range(6):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100)]
        chain = list(words)
        for _ in range(25):
            chain = list(chain)
            chain[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(chain))
    rng.shuffle(texts)
    want = components({i: shingles(t) for i, t in enumerate(texts)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, dense, filtered in ((1024, 4, 2048), (4, 0, 4), (3, 1, 2)):
        monkeypatch.setattr(linking, "BLOCK", block)
        monkeypatch.setattr(linking, "DENSE", dense)
        monkeypatch.setattr(linking, "FILTERED", filtered)
        got = {r.doc_id: r.component_id for r in jaccard_join.join(docs)[0].collect()}
        assert got == want


def test_lists_beyond_the_held_postings(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.randrange(40)) for _ in range(900)]
    monkeypatch.setattr(linking, "HELD", 50)
    monkeypatch.setattr(linking, "PACKED", 16)
    got = {(r.key, r.node) for r in linking.shared_lists(spark.createDataFrame(rows, "key long, node long").repartition(6)).collect()}
    at = {}
    for k, n in rows:
        at.setdefault(k, set()).add(n)
    assert got == {(k, n) for k, v in at.items() if len(v) > 1 for n in v}


def test_very_long_text_through_spark(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near(rng, words)), (3, " ".join(words[:150_000])), (4, "x" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs)[0].collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = llm_queries.QUERIES[name](spark, sf)
    want = con.sql(f"select {', '.join(sorted(df.columns))} from ({llm_queries.ORACLE_SQL[name]})").fetchall()
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    assert order(tuple(r) for r in df.select(*sorted(df.columns)).collect()) == order(want)


# --- the others


def test_rules_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as row", "'k' as kept")
    odd = spark.createDataFrame([(None, "a b c d e f g h i j k", None), (7, "x", "zz"), (7, "x", "zz"), (8, None, None)], "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "1L as n_chars", "1 as row", "'k' as kept")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", "row", "kept").unionByName(odd)
    key = lambda r: tuple((x is not None, x) for x in r)
    found = [sorted((tuple(r) for r in divergence.judge(d, divergence.reference_blocks(d)).collect()), key=key) for d in (rows.coalesce(1), rows.repartition(40))]
    assert found[0] == found[1] and len(found[0]) == rows.count()
    known = divergence.references(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r, text in [(r, texts[r[0]]) for r in found[0] if r[0] in texts and r[0] not in (7, 8)][:60]:
        words, text = (text or "").encode().split(), text or ""
        plain = [[words.count(w) for w in numbers] for numbers in known.words.values()]
        word = min(divergence.distance(np.array([*p, len(words) - sum(p)], float), known.counts[k]) for p, k in zip(plain, known.words)) if len(words) >= divergence.MIN_WORDS else None
        char = min(divergence.distance(divergence.character_classes(text), q) for q in known.characters.values()) if len(text) >= divergence.MIN_CHARS else None
        near_all = (char is None or char <= divergence.limit(divergence.CHAR_LIMIT, len(text))) and (word is None or word <= divergence.limit(divergence.WORD_LIMIT, len(words)))
        assert r[7] == (near_all and not r[6])
        assert r[8] == (None if char is None else pytest.approx(char, abs=1e-7)) and r[9] == (None if word is None else pytest.approx(word, abs=1e-7))


def test_token_counts_of_odd_rows(spark):
    pieces = vc.vocabulary(vc.default_vocabulary())
    known = vc.Counter(pieces)
    rows = [(1, None), (1, None), (None, "two words"), (2, ""), (3, "ab" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in vc.count_tokens(docs).collect())
    assert got == [(0, known.count("two words")), (1, 0), (1, 0), (2, 0), (3, known.count("ab" * 300_000))]
    assert vc.count_tokens(docs.limit(0)).count() == 0


def test_long_words_equal_whole_passes(monkeypatch):
    rng = random.Random(6)
    made = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 5))): float(-rng.randint(1, 3)) for _ in range(9)}
    text = "".join(rng.choice("aabbc") for _ in range(3000))
    whole = vc.Counter(list(made.items())).viterbi(text)
    for held in (7, 16, 1000):
        monkeypatch.setattr(vc, "HELD", held)
        assert vc.Counter(list(made.items())).viterbi(text) == whole


def test_spans_of_odd_rows(spark):
    text = "write to a@b.org"
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string").selectExpr("*", "1 as email", "2 as spans")
    got = sorted((r.doc_id or 0, [(s.start, s.end) for s in r.email]) for r in pii.find(docs).collect())
    assert got == [(0, [(9, 16)]), (1, [(9, 16)]), (1, [(9, 16)]), (2, [])]


PAGES = [
    (1, "http://h.org/a/p1", '<link rel="canonical" href="p2">'), (2, "http://h.org/a/p2", '<link rel=canonical href="http://x.example.com/de/1">'),
    (3, "http://h.org/b/c/p3", '<link href="../../a/./p2" rel="alternate canonical">'), (4, "http://h.org/q?x=1", '<link rel=canonical href="?x=1&amp;y=2">'),
    (5, "http://h.org/q?x=1&y=2", '<meta http-equiv=refresh content="0; URL=/a/p1">'), (6, "http://h.org/z/1", '<base href="/a/"><link rel="canonical" href="p1">'),
    (7, "http://h.org/n", '<!-- <link rel="canonical" href="/a/p1"> -->'), (8, "http://h.org/m", '<link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="/a/p1#top">'),
    (9, "http://h.org/o", '<link data-rel="canonical" href="/a/p1"><link rel="stylesheet" href="/a/p1">'), (9, "http://h.org/o", None), (None, "//no", '<link rel="canonical" href="/a/p1">'),
    (10, "http://k.org/1", '<link rel="canonical" href="//k.org/fr/1">'), (11, "http://k.org/2", '<link rel="canonical" href="/1">' + "x" * 300_000), (12, "http://k.org/3", '<link rel="canonical" href="http://s.net/x"><link rel="canonical" href="http://k.org/2">'),
]


def test_links_of_every_form(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'r' as rule", "1 as key")
    got = {(r.page_id, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    block, allow = {1, 2, 3, 4, 5, 6, 8}, {7, 9, None, 10, 11, 12}
    assert got == {(k, "block") for k in block} | {(k, "allow") for k in allow}
    assert url_filter.filter_urls(pages).count() == len(PAGES)


def test_redirects_of_a_log(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", None), (2, "http://b.org/2", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://a.org/1", "http://c.org/t"), ("http://c.org/t", "http://y.net/"), (None, "http://b.org/2")], "`from` string, `to` string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, redirects=log).collect()} == {1: "block", 2: "allow"}


# --- the pipeline


def piped(spark, docs, sf):
    out = []
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, sf)
        docs = linking.materialize(docs, "stage")
        out.append(docs)
    return out


def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = piped(spark, docs, sf)
    assert all(d.columns == docs.columns for d in out[:-1])
    sizes = [docs.count(), *(d.count() for d in out[:-1])]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    # each stage's rows by plain means from the rows before it
    from tests.llm.test_near import components, shingles

    texts = [{r.doc_id: r.text for r in d.collect()} for d in out[:-1]]
    parts = components({i: s for i, t in texts[1].items() if (s := shingles(t))})
    assert set(texts[2]) == {i for i in texts[1] if parts.get(i, i) == i}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(t in text for text in texts[3].values() for t in items) and all(texts[2][i] == t for i, t in texts[3].items())
    pieces = out[4].collect()
    assert {r.doc_id for r in pieces} == set(texts[3])
    filled = {}
    for r in pieces:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= bin_packing.CAPACITY
    rows = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)


def test_pipeline_of_odd_rows(spark, sf):
    long = " ".join(f"Sentence number {i} of a long and quiet text." for i in range(6000))
    rows = [(None, None), (None, "a row without an id"), (1, ""), (1, ""), (2, None), (3, long), (3, long), (4, "\n \n"), (5, "日本語 " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "'c' as _hash", "1 as node", "2 as row")
    out = piped(spark, docs, sf)
    assert all(d.columns == docs.columns for d in out[:-1])
    assert piped(spark, docs.limit(0), sf)[-1].count() == 0


def test_wide_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, both in ((1100, 1000, 900), (3000, 2500, 2400), (5000, 4100, 4000), (20_000, 20_000, 19_000), (4097, 4096, 10)):
        every = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        a, b = every[:n], every[n - both :]
        x, y = linking.wide_parity(a), linking.wide_parity(b)
        assert (x is None) == (n <= 1024) and (y is None) == (m <= 1024)
        if x and y:
            found = linking.wide_differing(np.array(x), np.array(y))
            assert found <= n + m - 2 * both and (both > 10 or 9 * found > n + m)  # a bound, and one that tells strangers apart


def test_wide_bitmaps_on_columns(spark):
    rng = np.random.default_rng(6)
    every = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    rows = []
    for k, (a, b) in enumerate(((every[:4100], every[300:4000]), (every[:2000], every[2000:4000]), (every[:900], every[:1000]), (every[:5000], every[:4000]))):
        rows.append((k, *linking.parity(a), linking.wide_parity(a), *linking.parity(b), linking.wide_parity(b)))
    names = ["n", *linking.SKETCH]
    schema = "k long, " + ", ".join(f"{c} long" for c in names) + ", wide array<long>, " + ", ".join(f"o_{c} long" for c in names) + ", o_wide array<long>"
    got = {r.k: r.may for r in spark.createDataFrame(rows, schema).select("k", linking.may_link().alias("may")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}
