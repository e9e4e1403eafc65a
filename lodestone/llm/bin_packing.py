"""Best-fit packing of token sequences by minimum bin slack.

Each bin is filled by a subset-sum dynamic program over the lengths that are left (a bitset of
reachable sums): the longest piece left opens the bin, the fullest feasible combination of the
others joins it and is removed. Only lengths decide, so the search runs over the histogram of
lengths, which has at most `capacity` entries whatever the number of pieces; one found
combination is applied as often as the counts allow. Pieces then look up their place by
(length, rank within the length), ranks being given out per bucket, never by one task a length.

Word pieces are remembered by 64-bit hashes (see wordbpe): of n different pieces that a worker meets
some two share one, and then ids, with probability n squared / 2^65.

Defined cases: a null text is an empty one and still has its end id; a text whose ids and end
id exceed the capacity is cut into full pieces, of which the last may be shorter, and no other
is cut; repeated rows are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.arrow import lean
from lodestone.llm.wordbpe import default_vocabulary, encoder
from lodestone.session import materialize, table

CAPACITY = 2048
END_ID = 0
#: Pieces that one bucket of ranks holds, about.
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, id_column: str, text_column: str, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text; ids are little-endian unsigned 32-bit integers."""
    path = vocabulary or default_vocabulary()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.binary()))
        schema += ", ids binary"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                out: list[tuple] = []
                for name, ids in zip(names, known.encode_all(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        raw = part.tobytes()
                        out.append((name, k, start, len(part), zlib.crc32(raw), *([raw] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def fullest(counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """The longest length left and, with it, the fullest combination: (length, times), longest first."""
    first = max(n for n in range(1, capacity + 1) if counts[n])
    room = capacity - first
    taken = {first: 1}
    mask = (1 << (room + 1)) - 1
    reach, before = 1, []
    for n in range(min(first, room), 0, -1):
        left = counts[n] - (n == first)
        for _ in range(min(left, room // n)):
            grown = reach | (reach << n) & mask
            if grown == reach:
                break
            before.append((n, reach))
            reach = grown
        if reach >> room & 1:
            break
    sum_ = reach.bit_length() - 1
    for n, was in reversed(before):
        if not was >> sum_ & 1:
            taken[n] = taken.get(n, 0) + 1
            sum_ -= n
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, times in a bin, bins, first bin, offset of the first copy), by length and rank."""
    counts = [histogram.get(n, 0) for n in range(capacity + 1)]
    used = [0] * (capacity + 1)
    out, bins = [], 0
    while any(counts):
        taken = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in taken)
        offset = 0
        for n, k in taken:
            out.append((n, used[n], k, times, bins, offset))
            used[n] += k * times
            counts[n] -= k * times
            offset += n * k
        bins += times
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def place(found: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces by length and rank."""
    at = np.searchsorted((found[:, 0] << 44) + found[:, 1], (length << 44) + rank, "right") - 1
    row = found[at]
    k, times = rank - row[:, 1], row[:, 3]
    return row[:, 4] + k % times, row[:, 5] + k // times * length


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with a length of 1 to capacity) plus sequence_id and offset."""
    if (bad := parts.filter((F.col("length") < 1) | (F.col("length") > capacity) | F.col("length").isNull()).limit(1)).count():
        raise ValueError(f"lengths must be from 1 to {capacity}: {bad.first()}")
    counted = parts.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counted.collect()}  # at most `capacity` rows
    found = plan(histogram, capacity)
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").count()
    bases = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base", "row")
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = place(found, length, batch.column("rank").to_numpy())
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*(f.name for f in fields), "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces with the sequence and offset that each goes to."""
    parts = pieces(docs, id_column, text_column, capacity, end_id, vocabulary).withColumn("row", F.monotonically_increasing_id())
    return pack(materialize(parts, "pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; a sequence gathers at most `capacity` ids."""
    parts = materialize(pieces(docs, "doc_id", "text", capacity, end_id, vocabulary, with_ids=True).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(parts, capacity)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
