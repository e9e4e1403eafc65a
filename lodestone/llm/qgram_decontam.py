"""Benchmark decontamination by the q-gram lemma and banded alignment.

Every benchmark item is covered by windows of WIDTH characters; equal windows are one. A document
region that holds a window with at most e edits shares at least w + 1 - q(e + 1) of its q-grams,
all on diagonals no more than e apart. So the q-grams that document and benchmark share are
counted in overlapping bands of diagonals, regions that meet the bound are retained, and each is
verified by a bit-parallel alignment of the window. A q-gram that a window holds more than once
counts once for a place of the text in each band that its places span, which can only add
regions to verify. Text is compared with A-Z and their Latin-1 kin in lower case.

Memory is bounded whatever repeats: places of the text are taken in pieces with at most PAIRS
(place, window) pairs that overlap by more than a region's length (one stretch of twice that
length is the least piece).

The benchmark goes to every task, in blocks of at most BLOCK_CHARS characters: a larger one takes
several passes over the documents, each written before the next, never a larger broadcast.

Defined cases: null or empty texts have no regions; items shorter than MIN_ITEM characters must
stand in the text exactly and between word borders; if shorter than Q they are too weak to make a
document contaminated and are reported apart (weak); null and blank items are not searched;
repeated items are all reported; repeated documents are judged one by one; an empty benchmark
finds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrow import lean
from lodestone.session import materialize, table

Q = 12
WIDTH, EDITS = 72, 4
BAND = 16
MIN_ITEM = 32
BLOCK_CHARS = 2_000_000
GROUP = 1 << 20
TABLE_BITS = 22
PAIRS = 1 << 21
#: Pieces of a text's places overlap by this much, more than a region is long.
OVERLAP = 2 * WIDTH

_LOWER = {c: ord(chr(c).lower()) for c in range(256) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256}
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(text: str) -> str:
    """Lower case of Latin-1 letters; one character stays one character."""
    return text.translate(_LOWER)


def as_bytes(text: str) -> bytes:
    """A byte a character; those outside Latin-1 share one, which can only add shared q-grams."""
    return text.encode("latin-1", "replace")


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the Q characters from each position."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = eight[:n] * _K1 + eight[Q - 8 : Q - 8 + n] * _K2
    h ^= h >> np.uint64(29)
    h *= _K1
    return h


class Window(NamedTuple):
    text: str
    edits: int
    bound: int  # shared q-grams that a region must have
    uses: list[int]  # the items' numbers in the block
    whole: bool  # a short item, which must stand between word borders

    @property
    def item(self) -> int:
        """The first that uses it."""
        return self.uses[0]


class Block(NamedTuple):
    """A block of items and the index of their q-grams."""

    ids: list
    windows: list[Window]
    present: np.ndarray  # bitmap over hash prefixes
    hashes: np.ndarray  # distinct, ascending
    firsts: np.ndarray  # where a hash's entries begin, and one more
    places: np.ndarray  # entries: position in the window
    owners: np.ndarray  # entries: window
    weak: ahocorasick.Automaton | None  # the items under Q characters


def window_rule(width: int) -> tuple[int, int]:
    """(edits allowed, shared q-grams needed) for a window of that many characters."""
    edits = EDITS * width // WIDTH
    while edits and width + 1 - Q * (edits + 1) < 1:
        edits -= 1
    return edits, max(1, width + 1 - Q * (edits + 1))


def cover(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a window's q-grams: a place each, and EDITS + 1 further for the band that overlaps; of repeated ones, places BAND apart from the first to the last, which meet the same bands."""
    order = np.argsort(found, kind="stable")
    starts = np.flatnonzero(np.append(True, found[order][1:] != found[order][:-1])) if len(found) else order
    last = np.append(starts[1:], len(found)) - 1
    hashes, places = [], []
    for h, low, high in zip(found[order][starts].tolist(), order[starts].tolist(), (order[last] + EDITS + 1).tolist() if len(found) else []):
        at = [*range(low, high, BAND), high]
        hashes += [h] * len(at)
        places += at
    return np.array(hashes, np.uint64), np.array(places, np.int64)


def build(items: list[tuple[int, str]]) -> Block:
    known: dict[tuple[str, bool], Window] = {}
    weak: dict[str, list[int]] = {}
    for k, (_, text) in enumerate(items):
        text = fold(text)
        if len(text) < MIN_ITEM:
            text = text.strip()
            if len(text) >= Q:
                known.setdefault((text, True), Window(text, 0, len(text) + 1 - Q, [], True)).uses.append(k)
            elif text:
                weak.setdefault(text, []).append(k)
            continue
        width = min(WIDTH, len(text))
        for start in sorted({*range(0, len(text) - width + 1, WIDTH // 2), len(text) - width}):
            part = text[start : start + width]
            uses = known.setdefault((part, False), Window(part, *window_rule(width), [], False)).uses
            if not uses or uses[-1] != k:
                uses.append(k)
    windows = list(known.values())
    hashes, places = zip(*(cover(gram_hashes(as_bytes(w.text))) for w in windows)) if windows else ((), ())
    owners = np.repeat(np.arange(len(windows)), [len(x) for x in hashes])
    every = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(every, kind="stable")
    distinct, firsts = np.unique(every[order], return_index=True)
    present = np.zeros(1 << TABLE_BITS, bool)
    present[distinct >> np.uint64(64 - TABLE_BITS)] = True
    automaton = None
    if weak:
        automaton = ahocorasick.Automaton()
        for text, uses in weak.items():
            automaton.add_word(text, (len(text), uses))
        automaton.make_automaton()
    return Block([i for i, _ in items], windows, present, distinct, np.append(firsts, len(every)), np.concatenate([np.zeros(0, np.int64), *places])[order], owners[order], automaton)


def align(pattern: str, region: str, edits: int) -> tuple[int, int, int] | None:
    """The best place of pattern in region with at most that many edits: (edits, start, end), the first of the best; start is exact up to the edits. A column of the alignment is a pair of bit vectors."""
    at = region.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    if not edits:
        return None
    size = len(pattern)
    top, full = 1 << (size - 1), (1 << size) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, cost = full, 0, size  # where the column rises and falls
    best = edits + 1, 0
    for end, c in enumerate(region, 1):
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(across | up)), up & across
        cost += bool(rise & top) - bool(fall & top)
        if cost < best[0]:
            best = cost, end
        rise, fall = (rise << 1) & full, (fall << 1) & full  # a place may begin anywhere: no cost from above
        keep = same | down
        up, down = fall | (full & ~(keep | rise)), rise & keep
    return None if best[0] > edits else (best[0], max(0, best[1] - size), best[1])


def search(texts: list[str | None], block: Block) -> Iterator[list[tuple[int, int, int, int]]]:
    """For each text its regions (item id, start, end, edits), by item and start; windows of an item that touch are joined."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(fold(text or ""))
        size += len(held[-1])
        if size > GROUP:
            yield from _search(held, block)
            held, size = [], 0
    yield from _search(held, block)


def weak_items(text: str | None, block: Block) -> list:
    """The ids of items under Q characters that stand in the text between word borders, each once."""
    if block.weak is None or not text:
        return []
    text = fold(text)
    found = {k for end, (size, uses) in block.weak.iter(text) if bordered(text, end + 1 - size, end + 1) for k in uses}
    return [block.ids[k] for k in sorted(found)]


def bordered(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def _bordered_place(pattern: str, text: str, first: int, last: int) -> tuple[int, int, int] | None:
    at = text.find(pattern, first, last)
    while at >= 0:
        if bordered(text, at, at + len(pattern)):
            return 0, at - first, at - first + len(pattern)
        at = text.find(pattern, at + 1, last)
    return None


def _bands(at: np.ndarray, slot: np.ndarray, doc: np.ndarray, bound: np.ndarray, block: Block) -> set[tuple[int, int, int]]:
    """(text, window, band) of the bands in which places at share enough q-grams (slot) with a window."""
    times = block.firsts[slot + 1] - block.firsts[slot]
    stops = np.append(0, np.cumsum(times))
    kept: set[tuple[int, int, int]] = set()
    begin = 0
    while begin < len(at):
        end = max(int(np.searchsorted(stops, stops[begin] + PAIRS, "right")) - 1, int(np.searchsorted(at, at[begin] + 2 * OVERLAP)))
        n = times[begin:end]
        which = np.repeat(np.arange(begin, end), n)
        entry = block.firsts[slot[which]] + np.arange(stops[end] - stops[begin]) - (stops[which] - stops[begin])
        owner, band = block.owners[entry], (at[which] - block.places[entry]) // BAND
        # the text is part of the key (a band may not add up the q-grams of two texts), and a place counts once
        order = np.lexsort((which, band, doc[which], owner))
        owner, band, which = owner[order], band[order], which[order]
        text = doc[which]
        new = np.append(True, (owner[1:] != owner[:-1]) | (band[1:] != band[:-1]) | (text[1:] != text[:-1]))
        once = new | np.append(True, which[1:] != which[:-1])
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(once.astype(np.int64), starts)
        hit = starts[counts >= bound[owner[starts]]]
        kept.update(zip(text[hit].tolist(), owner[hit].tolist(), band[hit].tolist()))
        if end >= len(at):
            break
        begin = max(begin + 1, int(np.searchsorted(at, at[end - 1] - OVERLAP)))
    return kept


def _search(texts: list[str], block: Block) -> Iterator[list[tuple[int, int, int, int]]]:
    raw = b"".join(map(as_bytes, texts))
    borders = np.cumsum([0, *map(len, texts)])
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    if len(block.hashes):
        bound = np.array([w.bound for w in block.windows])
        kept: set[tuple[int, int, int]] = set()
        for a in range(0, max(1, len(raw)), GROUP):
            part = raw[max(0, a - OVERLAP) : a + GROUP + Q - 1]
            hashes = gram_hashes(part)
            at = np.flatnonzero(block.present[hashes >> np.uint64(64 - TABLE_BITS)])
            slot = np.minimum(np.searchsorted(block.hashes, hashes[at]), len(block.hashes) - 1)
            same = block.hashes[slot] == hashes[at]
            at, slot = at[same] + max(0, a - OVERLAP), slot[same]
            doc = np.searchsorted(borders, at, "right") - 1
            inside = at + Q <= borders[doc + 1]
            kept |= _bands(at[inside], slot[inside], doc[inside], bound, block)
        for d, w, b in sorted(kept):
            window = block.windows[w]
            begin = b * BAND - int(borders[d])
            first, last = max(0, begin - window.edits), begin + BAND + EDITS + len(window.text) + window.edits
            hit = _bordered_place(window.text, texts[d], first, max(0, last)) if window.whole else align(window.text, texts[d][first : max(0, last)], window.edits)
            if hit:
                own = found.setdefault(d, [])
                for item in window.uses:
                    if own and own[-1][0] == item and own[-1][1] <= first + hit[1] <= own[-1][2] <= first + hit[2] and own[-1][3] == hit[0]:
                        own[-1] = (item, own[-1][1], first + hit[2], hit[0])  # long runs stay one
                    else:
                        own.append((item, first + hit[1], first + hit[2], hit[0]))
    for d in range(len(texts)):
        yield _joined(found.get(d, []), block.ids)


def _joined(hits: list[tuple[int, int, int, int]], ids: list) -> list[tuple[int, int, int, int]]:
    out: list[list[int]] = []
    for item, start, end, edits in sorted(set(hits)):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
            out[-1][3] = max(out[-1][3], edits)
        else:
            out.append([item, start, end, edits])
    return [(ids[item], start, end, edits) for item, start, end, edits in out]


def item_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Blocks of (item_id, text) of bounded size, fetched one after the other."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter(F.trim("text") != "").orderBy("item_id", "text").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield build(held)
            held, size = [], 0
    if held:
        yield build(held)


REGION = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


def find_regions(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, regions, weak) of every document; positions are code points, weak has the ids of items under Q characters."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    names = ("item_id", "start", "end", "edits")

    def one(block: Block) -> DataFrame:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    texts = part.column("text").to_pylist()
                    found = [[dict(zip(names, hit)) for hit in hits] for hits in search(texts, block)]
                    weak = pa.array([weak_items(text, block) for text in texts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(found, kind), weak], names=["doc_id", "row", "regions", "weak"])

        return chosen.mapInArrow(run, f"doc_id long, row long, regions {REGION}, weak array<bigint>")

    blocks = item_blocks(benchmark)
    first, second = next(blocks, None) or build([]), next(blocks, None)
    several = second is not None
    row = F.monotonically_increasing_id() if several else F.lit(0).cast("long")
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("row", row)
    if not several:
        return one(first).drop("row")
    chosen = materialize(chosen, "rows")  # fixes the row numbers for all passes
    found = materialize(one(first), "regions").union(materialize(one(second), "regions"))
    del first, second
    for block in blocks:
        found = found.union(materialize(one(block), "regions"))
    return found.groupBy("doc_id", "row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("regions", "weak"))).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item_id"])))
    spans = F.array_join(F.transform(F.array_sort("regions"), lambda r: F.concat_ws(":", r["item_id"], r["start"], r["end"])), ",")
    return found.select("doc_id", (F.size("regions") > 0).alias("contaminated"), F.size("regions").cast("long").alias("n_regions"), items.alias("item_ids"), spans.alias("spans"), F.array_sort(F.array_distinct("weak")).alias("weak_item_ids"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a region of the benchmark, one pass for each block of it."""
    kept = docs
    for number, block in enumerate(item_blocks(table(spark, sf_dir, "benchmark"))):

        @lean
        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield part.filter(pa.array([not hits for hits in search(part.column("text").to_pylist(), block)], pa.bool_()))

        if number:  # one worker a task, whatever the number of blocks
            kept = materialize(kept, "clean")
        kept = kept.mapInArrow(run, docs.schema)
    return kept
