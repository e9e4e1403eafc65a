"""Similarity join of documents on 5-word shingles by a size-aware heavy-light scheme.

A document's set holds its distinct shingles of WORDS words (A-Z in lower case). Documents with
equal sets are one node. Two sets of similarity 0.8 or more share at least 0.8 n shingles of
either, so under one global order of shingles they meet within the first n - ceil(0.8 n) + k of
them in at least k.
* Light sets (fewer than `boundary` shingles) enumerate the 2-subsets of that prefix (k = 2).
* Heavy sets scan inverted lists of single shingles of their prefix (k = 1); sets down to 0.8 of
  the boundary are on those lists too, so no pair across the boundary is missed.
The boundary is where enumerating subsets begins to cost more than scanning lists, by the mean
list length of this corpus. The global order puts the corpus's most frequent shingles last; it
decides only how many candidates there are, never which links are found. Candidates are verified
on their whole shingle sets, and links join documents into components (see linking).

Nodes are 64-bit hashes of sets: of n different sets some two share one with probability
n squared / 2^65. Texts are found again by 64-bit hashes of themselves, never by doc_id.

Defined cases: null texts and texts without words have an empty set and link with nothing;
repeated rows are copies, of which the stage keeps one; a doc_id may come with several texts, each judged by itself; a null
doc_id keeps its row and is no one's smallest id unless all are null; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import linking
from lodestone.llm.arrow import lean, unused
from lodestone.llm.textblocks import blocks, mix, words
from lodestone.session import materialize, table

WORDS = 5
#: The most frequent shingles that the global order puts last, and documents of a partition that make one a candidate for it.
FREQUENT, LOCAL = 65_536, 3
#: What verifying a candidate costs, in postings.
PAIR_COST = 4.0
SAMPLE = 256
_MULTIPLIERS = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)
_FIRST, _SECOND, _PAIR = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))
_UPPER = {i: i + 32 for i in range(65, 91)}


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes ascending) of every text of a column, rows in order."""
    held: list[np.ndarray] = []
    for block in blocks(column):
        _, _, part, hashes = words(block, lower=True)
        bounds = np.searchsorted(part, np.arange(len(block.rows) + 1))
        n = max(0, len(hashes) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled += hashes[k : k + n] * _MULTIPLIERS[k]
        rolled = mix(rolled)
        for i, row in enumerate(block.rows.tolist()):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if held or not block.last[i]:  # a part of a long text
                held.append(hashes[a:b])
                if not block.last[i]:
                    continue
                own = np.concatenate(held)
                held = []
                m = len(own) - WORDS + 1
                found = mix(sum((own[k : k + m] * _MULTIPLIERS[k] for k in range(WORDS)), np.zeros(max(m, 0), np.uint64))) if m > 0 else _short(own)
            else:
                found = rolled[a : b - WORDS + 1] if b - a >= WORDS else _short(hashes[a:b])
            yield row, np.unique(found)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer than WORDS words."""
    if not len(hashes):
        return hashes
    return mix((hashes * _MULTIPLIERS[: len(hashes)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))


def shingles(text: str) -> frozenset:
    """The set itself."""
    own = text.translate(_UPPER).encode("utf-8", "surrogatepass").split()
    if len(own) < WORDS:
        return frozenset([tuple(own)] if own else [])
    return frozenset(zip(*(own[k:] for k in range(WORDS))))


class Plan(NamedTuple):
    """The global order and the boundary of a corpus."""

    frequent: np.ndarray  # hashes, ascending
    weights: np.ndarray  # their document counts
    boundary: int


def prefix(n: int, k: int) -> int:
    return min(n, n - (linking.SIMILAR * n + 99) // 100 + k)


def choose_boundary(list_length: float) -> int:
    """The least size from which scanning lists is cheaper than enumerating 2-subsets."""
    n = 2
    while n < 400:
        light = prefix(n, 2)
        if light * (light - 1) / 2 > prefix(n, 1) * (1 + PAIR_COST * max(0.0, list_length - 1)):
            return n
        n += 1
    return n


def plan(docs: DataFrame) -> Plan:
    """Counts over all documents: which shingles are frequent, and how long lists are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            distinct, counts = np.unique(np.concatenate(held), return_counts=True)
            sampled = distinct % np.uint64(SAMPLE) == 0
            keep = sampled | (counts >= LOCAL)
            return pa.RecordBatch.from_arrays([pa.array(distinct[keep].view(np.int64)), pa.array(counts[keep])], names=["hash", "n"])

        for batch in batches:
            for _, found in shingle_sets(batch.column(0)):
                held.append(found)
                size += len(found)
                if size > 2_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counted = materialize(docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "counts")
    top = counted.filter(F.col("n") >= 2 * LOCAL).orderBy(F.desc("n"), "hash").limit(FREQUENT).toPandas()  # at most FREQUENT rows
    # lists of prefixes hold rare shingles: those of the most frequent ones stay out of the mean
    rare = counted.filter((F.pmod("hash", F.lit(SAMPLE)) == 0) & (F.col("n") < 64)).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).first()["mean"]
    frequent = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    return Plan(frequent[order], top["n"].to_numpy(np.int64)[order], choose_boundary(rare or 1.0))


def keys_of(found: np.ndarray, known: Plan) -> np.ndarray:
    """The keys under which a set is listed."""
    n = len(found)
    if n < 2:
        return found[:0]
    weight = np.zeros(n, np.int64)
    if len(known.frequent):
        at = np.minimum(np.searchsorted(known.frequent, found), len(known.frequent) - 1)
        weight = np.where(known.frequent[at] == found, known.weights[at], 0)
    ordered = found[np.lexsort((found, weight))]
    out = []
    if n < known.boundary:
        head = ordered[: prefix(n, 2)]
        i, j = np.triu_indices(len(head), 1)
        out.append(mix(head[i] * _MULTIPLIERS[0] + head[j] * _MULTIPLIERS[1] + _PAIR))
    if 100 * n >= linking.SIMILAR * known.boundary:
        out.append(ordered[: prefix(n, 1)])
    return np.concatenate(out)


def sets(docs: DataFrame, known: Plan) -> DataFrame:
    """Of docs(doc_id, text, text_hash): (doc_id, text_hash, n_shingles, node, keys, n, s0.., wide); keys and sketch only where this partition has not listed the node yet."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: set[int] = set()
        names = ["doc_id", "text_hash", "n_shingles", "node", "keys", "n", *linking.SKETCH, "wide"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.int64()] * (1 + len(linking.SKETCH)) + [pa.list_(pa.int64())]

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[list] = [[] for _ in names]
            for row, found in shingle_sets(batch.column(1)):
                n = len(found)
                node = int(mix(mix(found ^ _FIRST).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _SECOND).view(np.int64)[0]) if n else None
                fresh = n > 1 and node not in listed
                if fresh:
                    listed.add(node)
                    if len(listed) > 500_000:
                        listed.clear()  # then some are listed twice, to no harm
                for column, value in zip(out, (ids[row], hashes[row], n, node, keys_of(found, known).view(np.int64) if fresh else None, *(linking.parity(found) if fresh else [None] * (1 + len(linking.SKETCH))), linking.wide_parity(found) if fresh else None)):
                    column.append(value)
                if len(out[0]) >= 1024:
                    yield made()
                    out = [[] for _ in names]
            if out[0]:
                yield made()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "text_hash")
    return chosen.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, keys array<long>, n long, " + ", ".join(f"{s} long" for s in linking.SKETCH) + ", wide array<long>")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[linking.Postings]:
    """Of (node, keys, n): every key of a node; marks are the sizes of sets."""
    for batch in batches:
        node, keys, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
        times = np.diff(np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1])
        yield keys.flatten().to_numpy().view(np.uint64), np.repeat(node, times), np.repeat(n, times)


def _packed_sets(contents: DataFrame) -> DataFrame:
    """(node, content) with texts to (node, content) with their sets, as ascending 64-bit hashes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [own.tobytes() for _, own in shingle_sets(part.column("content"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "content"])

    return contents.select("node", "content").mapInArrow(run, "node long, content binary")


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of packed sets in order, and how many each has."""
    at = linking._offsets(column)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view(np.uint64) if data is not None else np.zeros(0, np.uint64), np.diff(at) // 8


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, text_hash, n_shingles, node, component_id), and the links (a, b) between nodes."""
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = materialize(sets(chosen, plan(chosen)), "sets")
    postings = linking.packed(found.filter("keys is not null").select("node", "keys", "n"), _postings)
    lists = materialize(linking.listed(postings, linking.fitting_sizes), "lists")
    firsts = found.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash"))

    def contents(nodes: DataFrame) -> DataFrame:
        some = materialize(firsts.join(nodes, "node", "left_semi").select("node", "text_hash"), "firsts")
        small = linking.only(chosen, some.select(F.col("text_hash").alias("node")), "text_hash")
        once = small.groupBy("text_hash").agg(F.min("text").alias("content"))  # copies meet before the shuffle
        return _packed_sets(once.join(some, "text_hash"))

    links, parts = linking.link(lists, linking.fitting_sizes, contents, decode, found.filter("n is not null").select("node", "n", *linking.SKETCH, "wide"))
    classes = firsts.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialize(classes.join(least, "component").select("node", "component_id"), "classes")
    named = found.join(classes, "node", "left").select("doc_id", "text_hash", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return named, links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))[0].drop("node", "text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, of several texts of that id the one with the least hash, of repeated rows any one.

    Documents without words, and rows with a null doc_id, are kept."""
    found = join(docs)[0].filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.first("component_id").alias("component_id"))
    least = rows.filter("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("kept_hash"), F.count("*").alias("texts"))
    doc, text, own = unused(docs, "_id", "_text", "_own")
    named = rows.join(least.filter("texts > 1").drop("texts"), "component_id", "left")
    named = materialize(named.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), "rows", ((F.col("doc_id") != F.col("component_id")) | (F.col("text_hash") != F.coalesce("kept_hash", "text_hash"))).alias("gone")), "named")
    keyed = docs.withColumns({own: F.xxhash64("text")})
    match = lambda other: (F.col("doc_id").cast("long") == other[doc]) & (F.col(own) == other[text])
    gone, twice = named.filter("gone").drop("rows", "gone"), named.filter("not gone and rows > 1").drop("rows", "gone")
    kept = keyed.join(gone, match(gone), "left_anti")
    if not twice.isEmpty():
        once = kept.join(twice, match(twice), "left_semi").withColumn(doc, F.col("doc_id").cast("long")).dropDuplicates([doc, own]).drop(doc)
        kept = kept.join(twice, match(twice), "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same classes by a join on rare shingles: two sets of similarity 0.8 share one of the n - ceil(0.8 n) + 1 rarest of either.
ORACLE = r"""
WITH RECURSIVE named AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), elements AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM named
), sizes AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id
), shares AS (SELECT s, count(*) AS c FROM elements GROUP BY s
), ranked AS (
  SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS place FROM elements JOIN shares USING (s) JOIN sizes USING (doc_id)
), heads AS (SELECT doc_id, n, s FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m FROM heads x JOIN heads y ON x.s = y.s AND x.doc_id < y.doc_id WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
), links AS (
  SELECT a, b FROM pairs JOIN elements x ON x.doc_id = a JOIN elements y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, n, m HAVING 100 * count(*) >= 80 * (n + m - count(*))
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN ways ON a = other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
