import io
import os
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import arrow, bin_packing, dac_ids, wordbpe
from lodestone.llm.wordbpe import WordEncoder, default_vocabulary
from lodestone.session import scratch_path

HARD = ["a\x1cb c\x85d", " ", "'s it's don't", "x<|endoftext|>y <|startoftext|>", "İstanbul ßẞ ÀÉ é ́x", "½ ² ª º 12 34a", "日本語 テスト!! ..,, a.b.c", "a b　c​d", "a\x00b", "µm ×÷", "", None, "ÀÞ×ßÿ ΣΑΣ"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(default_vocabulary())


def expected(whole, texts, end):
    return [np.array(e.ids + [end], np.uint32) for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts_of(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [r.doc_id for r in rows], [r.text for r in rows]


@pytest.mark.parametrize("long", [1 << 21, 50])
def test_encoder_equals_library(spark, sf, whole, monkeypatch, long):
    monkeypatch.setattr(wordbpe, "LONG", long)
    _, texts = texts_of(spark, sf)
    texts = texts + HARD
    got = list(WordEncoder(default_vocabulary()).encode_all(texts))
    for a, b in zip(got, whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert a.tolist() == b.ids


def test_encoder_forgets(spark, sf, whole, monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMO_LIMIT", 300)
    _, texts = texts_of(spark, sf)
    got = list(WordEncoder(default_vocabulary()).encode_all(texts[:60]))
    assert [a.tolist() for a in got] == [e.ids for e in whole.encode_batch(texts[:60], add_special_tokens=False)]


def test_encoder_memory():
    """Rare pieces are most of a corpus's; a dictionary of Python integers took 156 bytes for each."""
    n = 100_000
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(5))
    texts = [" ".join(word(k) for k in range(i, i + 10_000)) for i in range(0, n, 10_000)]
    known = WordEncoder(default_vocabulary())
    known.encode("warm up")
    tracemalloc.start()
    for text in texts:
        known.encode(text)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 80 * n


def test_workers_give_memory_back():
    """After a task's last batch a worker must not keep the batches' memory for later stages."""

    def own():
        with open("/proc/self/statm") as f:
            _, resident, shared = map(int, f.read().split()[:3])
        return (resident - shared) * os.sysconf("SC_PAGE_SIZE")

    def run(batches):
        held = [pa.RecordBatch.from_arrays([pa.array(range(1 << 16)).take(pa.array(np.arange(1 << 16)))], names=["x"]) for _ in batches]
        yield from held

    arrow.give_back()
    before = own()
    assert sum(b.num_rows for b in arrow.lean(run)(iter(range(400)))) == 400 << 16  # 200 MB
    assert own() < before + (64 << 20)


def test_block_round_trip_and_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rng.integers(0, 49408, 3000).astype(np.uint32)):
        if len(ids):
            assert (dac_ids.decode_block(dac_ids.encode_block(ids)) == ids).all()


def test_file_random_access(monkeypatch, tmp_path):
    monkeypatch.setattr(dac_ids, "BLOCK_IDS", 1000)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 70000, n).astype(np.uint32) for n in (0, 1, 999, 1, 2500, 3)]
    with pa.OSFile(str(tmp_path / "x"), "wb") as f:
        w = dac_ids.DacWriter(f)
        for i, d in enumerate(docs):
            w.add(i or None, d)
        w.close()
    flat = np.concatenate(docs)
    with pa.OSFile(str(tmp_path / "x"), "rb") as f:
        r = dac_ids.DacReader(f)
        assert [r.token(i) for i in range(len(flat))] == flat.tolist()
        for (doc, start, parts), (i, d) in zip(r.documents(), enumerate(docs)):
            assert doc == (i or None)
            assert np.concatenate([np.zeros(0, np.uint32), *parts]).tolist() == d.tolist()
        with pytest.raises(IndexError):
            r.token(len(flat))


def test_dac_query(spark, sf, whole):
    ids, texts = texts_of(spark, sf)
    want, start = {}, 0
    for i, e in zip(ids, expected(whole, texts, 1)):
        want[i] = (start, len(e), zlib.crc32(e.astype("<u4").tobytes()))
        start += len(e)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in dac_ids.query(spark, sf).collect()}
    assert got == want


def odd_docs(spark):
    rows = [(3, "x y", 1), (1, None, 2), (None, "z", 3), (2, "", 4), (3, "x y", 5), (4, "word " * 5000, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int")


def test_dac_odd_rows(spark, whole):
    to = scratch_path(spark, "t")
    rows = dac_ids.read(dac_ids.write(odd_docs(spark), to), to).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 4]
    assert [r.n_tokens for r in rows] == [2, 1, 1, 3, 3, 5001]
    empty = odd_docs(spark).limit(0)
    to = scratch_path(spark, "t")
    assert dac_ids.read(dac_ids.write(empty, to), to).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_query(spark, sf, whole):
    ids, texts = texts_of(spark, sf)
    rows = bin_packing.query(spark, sf).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for i, e in zip(ids, expected(whole, texts, 0)):
        for k, s in enumerate(range(0, len(e), 2048)):
            part = e[s : s + 2048]
            want[i, k] = (s, len(part), zlib.crc32(part.astype("<u4").tobytes()))
    assert got == want
    bins = check_packing(rows, 2048)
    assert len(bins) <= -(-sum(v[1] for v in want.values()) // 2048) + 1


def test_packing_odd_rows(spark):
    rows = bin_packing.pack_documents(odd_docs(spark)).collect()
    assert len(rows) == 8
    check_packing(rows, 2048)
    assert bin_packing.pack_documents(odd_docs(spark).limit(0)).count() == 0
    made = bin_packing.sequences(odd_docs(spark), capacity=64).collect()
    assert all(len(r.ids) == 4 * r.length and r.length <= 64 for r in made)


def test_fullest_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cap = int(rng.integers(5, 25))
        lengths = rng.integers(1, cap + 1, int(rng.integers(1, 9))).tolist()
        counts = [lengths.count(n) for n in range(cap + 1)]
        taken = dict(bin_packing.fullest(counts, cap))
        rest = sorted(lengths)[:-1]
        best = max(s for m in range(1 << len(rest)) if (s := max(lengths) + sum(x for i, x in enumerate(rest) if m >> i & 1)) <= cap)
        assert sum(n * k for n, k in taken.items()) == best
        assert all(k <= counts[n] for n, k in taken.items())
