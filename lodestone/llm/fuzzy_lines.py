"""Removal of near-duplicate lines by MinHash.

A line is what stands between newlines, without outer white space; every line with a character
takes part. Its set holds the shingles of K characters (letters folded to lower case); a shorter
line is one shingle. BANDS bands of ROWS minima find candidates: a pair of
similarity 0.8 is missed with probability (1 - 0.8^ROWS)^BANDS, under 0.2 %, and the exact
similarity of every candidate is verified, but for those whose marks (two bits of 32 minima)
agree in fewer than MARK_AGREE places. Verified links make components, in which the line of
the least (doc_id, line number) is kept and all others go.

Lines are named by 64-bit hashes: of n different lines some two share one with probability
n squared / 2^65.

Defined cases: a null text has no lines; blank lines are kept; rows equal in doc_id and text are
one document and keep the same lines; a null doc_id sorts first; a document that loses all its
lines but blank ones is dropped by the stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import linking
from lodestone.llm.arrow import rows as row_tuples
from lodestone.llm.arrow import lean, unused
from lodestone.llm.qgram_decontam import fold
from lodestone.llm.textblocks import mix
from lodestone.session import materialize, table

MIN_CHARS = 1
#: One changed character costs K shingles: a line of 49 characters still links. Below 5, long lines of one language
#: would share most of their shingles without being copies.
K = 5
BANDS, ROWS = 12, 4
#: Besides the band in common, a pair of similarity 0.8 agrees in fewer of a mark's 32 parts with probability 0.00004, one of similarity 0.2 in as many with 0.05, of 0.1 with 0.005.
MARK_AGREE = 19
#: Characters whose shingles are hashed at a time.
CHUNK = 1 << 16
WHITE = " \t\r\v\f"
_LOWER = bytes(ord(fold(chr(i))) for i in range(256))
_RNG = np.random.Generator(np.random.PCG64(99))
_A = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_CHARS = mix(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)


def node_of(line: str) -> int:
    """The hash of a line that Spark's xxhash64 gives, as an unsigned number."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(node, line) of the lines that take part."""
    each = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.btrim("line", F.lit(WHITE)).alias("line"))
    return each.filter(F.char_length("line") >= min_chars).select(F.xxhash64("line").alias("node"), "line")


def line_nodes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, line_no, node) of the lines that take part."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[int] = []
                numbers: list[int] = []
                nodes: list[int] = []
                for row, text in enumerate(part.column("text").to_pylist()):
                    for number, line in enumerate((text or "").split("\n")):
                        line = line.strip(WHITE)
                        if len(line) >= min_chars:
                            rows.append(row)
                            numbers.append(number)
                            nodes.append(node_of(line))
                take = pa.array(rows, pa.int32())
                columns = [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(numbers, pa.int32()), pa.array(np.array(nodes, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "line_no", "node"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, line_no int, node long")


def shingles(line: str) -> frozenset:
    line = fold(line)
    return frozenset(line[i : i + K] for i in range(max(1, len(line) - K + 1)))


def code_points(text: str) -> np.ndarray:
    """Code points with Latin-1 letters in lower case."""
    try:
        return np.frombuffer(text.encode("latin-1").translate(_LOWER), np.uint8)
    except UnicodeEncodeError:
        data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        small = data < 256
        data[small] = np.frombuffer(_LOWER, np.uint8)[data[small]]
        return data


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles of all lines, in order; how many each has)."""
    padded = [x.ljust(K, "\0") for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    data = code_points("".join(padded)).astype(np.uint64)
    n = len(data) - K + 1
    hashes = data[:n] * _CHARS[0]
    one = np.empty_like(hashes)
    for k in range(1, K):
        hashes += np.multiply(data[k : k + n], _CHARS[k], out=one)
    ends = np.cumsum(sizes)
    inside = np.ones(len(data), bool)
    for k in range(1, K):
        inside[ends - k] = False
    return mix(hashes[inside[:n]]), sizes - K + 1


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of a column of lines."""
    return shingle_hashes(column.to_pylist())


def minima(lines: list[str]) -> np.ndarray:
    """BANDS * ROWS minima: a row a line."""
    hashes, counts = shingle_hashes(lines)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    least, one = np.empty((BANDS * ROWS, len(lines)), np.uint32), np.empty_like(short)
    for k in range(BANDS * ROWS):
        np.multiply(short, _A[k], out=one)  # hashes are mixed already, so an odd factor permutes well enough
        np.minimum.reduceat(one, starts, out=least[k])
    return least.T


def signatures(lines: list[str], least: np.ndarray | None = None) -> np.ndarray:
    """Band keys: a row a line."""
    least = minima(lines) if least is None else least
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(band * ROWS, band * ROWS + ROWS):
            keys[:, band] = mix(keys[:, band] + least[:, row] + np.uint64(1))
        keys[:, band] = mix(keys[:, band] + np.uint64(band))
    return keys


def marks(least: np.ndarray) -> np.ndarray:
    """Two bits of 32 of the minima (all bands have a share in them), a 64-bit number a line."""
    chosen = np.arange(32) % BANDS * ROWS + np.arange(32) // BANDS
    two = least[:, chosen].astype(np.uint64) & np.uint64(3)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64).view(np.int64)


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether at least MARK_AGREE of the 32 minima agree in two bits."""
    differing = (a ^ b).view(np.uint64)
    differing |= differing >> np.uint64(1)
    return np.bitwise_count(differing & np.uint64(0x5555555555555555)) <= 32 - MARK_AGREE


def line_postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """The packed postings of docs(text): band keys of each distinct line that a worker sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[linking.Postings]:
        seen: set[int] = set()
        nodes: list[int] = []
        lines: list[str] = []
        size = 0

        def made() -> linking.Postings:
            least = minima(lines)
            return signatures(lines, least).ravel(), np.repeat(np.array(nodes, np.uint64).view(np.int64), BANDS), np.repeat(marks(least), BANDS)

        for (text,) in row_tuples(batches):
            for line in (text or "").split("\n"):
                line = line.strip(WHITE)
                if len(line) < min_chars:
                    continue
                node = node_of(line)
                if node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                lines.append(line)
                size += len(line)
                if size > CHUNK:
                    yield made()
                    nodes, lines, size = [], [], 0
            if len(seen) > 500_000:
                seen.clear()  # then some are listed twice, to no harm
        if lines:
            yield made()

    return linking.packed(docs.select("text"), run)


def coordinates() -> Column:
    return F.struct("doc_id", "text_hash", "line_no")


def duplicates(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """(doc_id, text_hash, removed array<int>): the line numbers that each document loses."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    least = MIN_CHARS if min_chars is None else min_chars

    lists = materialize(linking.listed(line_postings(chosen, least), fits), "lists")
    nodes = materialize(linking.listed_nodes(lists), "nodes")
    contents = linking.only(lines_of(chosen, least), nodes).dropDuplicates(["node"]).withColumnRenamed("line", "content")
    _, parts = linking.link(lists, fits, materialize(contents, "contents"), decode)
    placed = line_nodes(chosen, least).join(linking.fewer(parts).withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed.drop("node"), "placed")
    several = materialize(placed.groupBy("component").agg(F.count("*").alias("lines")).filter("lines > 1"), "several")
    some = materialize(linking.join_sized(placed, several, "component", "lines"), "some")
    keep = materialize(some.groupBy("component").agg(F.min(coordinates()).alias("keep"), F.first("lines").alias("lines")), "keep")
    lost = linking.join_sized(some.drop("lines"), keep, "component", "lines").filter(~coordinates().eqNullSafe(F.col("keep")))
    return lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def without(docs: DataFrame, lost: DataFrame, changed: str) -> DataFrame:
    """docs with text without those lines, and a column changed that tells which texts have lost any."""
    own, doc, text, gone = unused(docs.withColumn(changed, F.lit(0)), "_hash", "_lost_id", "_lost_text", "_removed")
    lost = lost.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("removed").alias(gone))
    joined = docs.withColumn(own, F.xxhash64("text")).join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text)), "left")

    def kept(lines: Column) -> Column:  # by a hash of the numbers: linear, however many lines go
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    rest = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), kept), 1)
    done = joined.withColumns({"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest), changed: F.col(gone).isNotNull()})
    return done.drop(own, doc, text, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): a digest of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = duplicates(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    joined = rows.join(lost.withColumnsRenamed({"doc_id": "lost_id", "text_hash": "lost_text"}), F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_text")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without duplicate lines; one that has nothing left but white space goes."""
    (changed,) = unused(docs, "_changed")
    done = without(docs, duplicates(docs), changed).filter(~F.col(changed) | (F.btrim("text", F.lit(WHITE + "\n")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col(changed), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))
