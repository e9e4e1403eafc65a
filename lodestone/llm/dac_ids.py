"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id; a
continuation bitmap says which ids go on, and level 1 holds the next chunk of those, and so on.
A rank directory over each bitmap (the count before every 512 bits) turns a position in one
level into the position in the next, so any id is read with a few bytes and no block is decoded.

A file is one range of doc_id in ascending order:
  magic "LDAC", u32 version
  blocks of BLOCK_IDS ids: u32 levels, then a u32 count a level; each level's chunks, and for all
    but the last level its bitmap (u64 words) and rank directory (u32 a 512 bits and one more)
  footer: doc_id i64[docs], start u64[docs + 1], block offsets u64[blocks]
  trailer: u64 docs, u64 blocks, u64 footer offset, magic
All integers are little-endian. A null doc_id is kept as -2^63.

Files are written under a name of the task attempt; only the attempt whose row reached the
manifest is read, so a lost executor leaves at most an unread file. Null texts have only the end
id. Repeated doc_ids are kept, in the order of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.wordbpe import default_vocabulary, encoder
from lodestone.session import materialize, scratch_path, table

MAGIC = b"LDAC"
VERSION = 1
BLOCK_IDS = 1 << 18
END_ID = 1
NULL_ID = -(1 << 63)
RANK_BITS = 512


def encode_block(ids: np.ndarray) -> bytes:
    """One block of unsigned 32-bit ids."""
    levels: list[tuple[np.ndarray, np.ndarray | None]] = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        last = not more.any()
        levels.append(((rest & 255).astype(np.uint8), None if last else more))
        if last:
            break
        rest = rest[more] >> np.uint32(8)
    out = [np.array([len(levels), *(len(chunks) for chunks, _ in levels)], "<u4").tobytes()]
    for chunks, more in levels:
        out.append(chunks.tobytes())
        if more is not None:
            bits = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, bool)
            bits[: len(more)] = more
            packed = np.packbits(bits, bitorder="little")
            ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, RANK_BITS).sum(1))])
            out += [packed.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(out)


def _layout(sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Where each level's chunks, bitmap and ranks begin in a block."""
    at, out = 4 * (len(sizes) + 1), []
    for k, n in enumerate(sizes.tolist()):
        bits = -(-n // RANK_BITS) * RANK_BITS
        out.append((at, at + n, at + n + bits // 8))
        at += n + (0 if k == len(sizes) - 1 else bits // 8 + 4 * (bits // RANK_BITS + 1))
    return out


def decode_block(raw: bytes) -> np.ndarray:
    levels = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", levels, 4)
    ids: np.ndarray | None = None
    at: np.ndarray | None = None
    for k, (chunks, bitmap, _) in enumerate(_layout(sizes)):
        n = int(sizes[k])
        values = np.frombuffer(raw, np.uint8, n, chunks).astype(np.uint32)
        if ids is None:
            ids, at = values, np.arange(n)
        else:
            ids[at] |= values << np.uint32(8 * k)
        if k < levels - 1:
            more = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), bitmap), count=n, bitorder="little").astype(bool)
            at = at[more]
    return ids if ids is not None else np.zeros(0, np.uint32)


class DacWriter:
    """Takes documents in order; holds at most one block of ids and the document table."""

    def __init__(self, sink: pa.NativeFile) -> None:
        self.sink, self.docs, self.starts, self.blocks = sink, [], [0], []
        self.held: list[np.ndarray] = []
        self.n = 0
        self.sink.write(MAGIC + VERSION.to_bytes(4, "little"))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        begin = 0
        while len(ids) - begin >= BLOCK_IDS or all_of_it and begin < len(ids):
            self.blocks.append(self.sink.tell())
            self.sink.write(encode_block(ids[begin : begin + BLOCK_IDS]))
            begin += BLOCK_IDS
        self.held = [ids[begin:]]
        self.n = max(0, len(ids) - begin)

    def close(self) -> int:
        self._flush(True)
        footer = self.sink.tell()
        self.sink.write(np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.blocks, "<u8").tobytes())
        self.sink.write(np.array([len(self.docs), len(self.blocks), footer], "<u8").tobytes() + MAGIC)
        return self.starts[-1]


class DacReader:
    """ids of a file: token(i) reads a few bytes at their places, documents() streams all."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        size = source.size()
        tail = self._read(size - 28, 28)
        if tail[24:] != MAGIC or self._read(0, 4) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, blocks, footer = np.frombuffer(tail, "<u8", 3).tolist()
        raw = self._read(footer, size - 28 - footer)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.blocks = [*np.frombuffer(raw, "<u8", blocks, 16 * docs + 8).tolist(), footer]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def token(self, i: int) -> int:
        if not 0 <= i < self.starts[-1]:
            raise IndexError(i)
        base = self.blocks[i // BLOCK_IDS]
        i %= BLOCK_IDS
        levels = int.from_bytes(self._read(base, 4), "little")
        sizes = np.frombuffer(self._read(base + 4, 4 * levels), "<u4")
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(_layout(sizes)):
            value |= self._read(base + chunks + i, 1)[0] << (8 * k)
            if k == levels - 1:
                break
            line = i // RANK_BITS
            bits = int.from_bytes(self._read(base + bitmap + line * RANK_BITS // 8, RANK_BITS // 8), "little")
            if not bits >> (i % RANK_BITS) & 1:
                break
            before = int.from_bytes(self._read(base + ranks + 4 * line, 4), "little")
            i = before + (bits & ((1 << (i % RANK_BITS)) - 1)).bit_count()
        return value

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, its start in the file, its ids in parts); the parts of one are to be taken before the next."""
        number, block = -1, np.zeros(0, np.uint32)

        def parts(start: int, end: int) -> Iterator[np.ndarray]:
            nonlocal number, block
            while start < end:
                if start // BLOCK_IDS != number:
                    number = start // BLOCK_IDS
                    block = decode_block(self._read(self.blocks[number], self.blocks[number + 1] - self.blocks[number]))
                stop = min(end, (number + 1) * BLOCK_IDS)
                yield block[start - number * BLOCK_IDS : stop - number * BLOCK_IDS]
                start = stop

        for doc, start, end in zip(self.doc_ids.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist()):
            yield (None if doc == NULL_ID else doc), start, parts(start, end)


def write(docs: DataFrame, to: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Write every whole text's ids under the folder `to` in ascending doc_id; the manifest (shard, path, docs, tokens, start)."""
    path = vocabulary or default_vocabulary()
    fields = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        known = encoder(path)
        store, folder = fs.FileSystem.from_uri(to)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.dac"
        with store.open_output_stream(name) as sink:
            writer = DacWriter(sink)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    names, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                    for doc, ids in zip(names, known.encode_all(texts)):
                        writer.add(doc, np.append(ids, np.uint32(end_id)))
            tokens = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((task.partitionId(), name, len(writer.docs), tokens), fields)], schema=fields)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = chosen.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = materialize(ordered.mapInArrow(run, "shard int, path string, docs long, tokens long"), "manifest")
    # one row a file: the window over all of them is small however many documents there are
    return manifest.withColumn("start", F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])


def read(manifest: DataFrame, to: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files, a file a task."""
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(to)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(name) as source:
                    out: list[list] = [[], [], [], []]
                    for doc, start, parts in DacReader(source).documents():
                        crc = n = 0
                        for part in parts:
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            n += len(part)
                        for column, value in zip(out, (doc, base + start, n, crc)):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, fields)], schema=fields)

    files = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch_path(spark, "dac")
    return read(write(table(spark, sf_dir, "documents"), to), to)
