"""From postings to connected classes of similar texts, without all pairs of a group.

Postings (key, node, mark) name the keys of each distinct text (node); similar nodes share a key
and have fitting marks (what a mark is, the caller says: a size, or some bits of a signature).
1. Workers pack postings into one block a shuffle partition, so that Spark moves few rows and
   sorts none. A partition's blocks are sorted as arrays; keys with one node fall away, and so do
   nodes whose mark fits no other mark of their list. Beyond HELD postings a worker keeps only
   the first node of each key and hands all later ones on unfiltered: memory stays bounded.
   Lists of at most SHORT nodes end as their pairs; pairs of several lists meet once.
2. Each longer list has its first node as leader. Distinct pairs, and (leader, node), whose
   sketches admit the similarity are verified on whole sets; verified links make components.
3. Longer lists that still span components go on, cut into blocks by a hash of the node, so that a long
   list becomes many small groups (one for each two of its blocks). A worker compares sketches of
   nodes of different components. A group with at most DENSE pairs a node hands all of them on,
   to be verified once whatever lists they share; a denser one hands on its nodes instead.
4. Of the denser groups, those that still span components then have their sets fetched and are
   joined by union-find, which verifies a pair only if its ends are not tied yet.
A link that is skipped lies inside a component already, so the components are those of all links
between nodes that share a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import lean
from lodestone.llm.components import connected_components
from lodestone.session import materialize

#: Similarity in hundredths; a pair links if 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Nodes up to this number are broadcast (some 30 MB) to find their texts; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Postings that a worker packs at a time, and those that one holds before it keeps first nodes only.
PACKED, HELD = 1 << 20, 1 << 23
#: Lists beyond this length are not filtered by marks.
FILTERED = 2048
#: A list of up to this many nodes is handed on as its pairs, at most (SHORT - 1) / 2 a node.
SHORT = 8
#: Sketches up to this number are broadcast (some 40 MB).
BROADCAST_SKETCHES = 200_000
#: Nodes of a list's block, and pairs a node that a group of blocks hands on.
BLOCK, DENSE = 1024, 1
#: Sets that one is compared with at a time.
TOGETHER = 64
#: A key with more than this share of all rows is hot: at most 1 / HOT keys are.
HOT = 1e-3

Postings = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, nodes, marks
Fits = Callable[[np.ndarray, np.ndarray], np.ndarray]  # marks, marks -> whether the nodes may link
Contents = DataFrame | Callable[[DataFrame], DataFrame]  # (node, content) of all listed nodes as a written table, or what gives that of a table of nodes
Decode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]  # contents -> hashes of all sets in order, and how many each has


def any_marks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.ones(len(a), bool)


def fitting_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks are sizes of sets: the smaller is at least SIMILAR hundredths of the larger."""
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * SIMILAR


def packed(df: DataFrame, postings: Callable[[Iterator[pa.RecordBatch]], Iterator[Postings]]) -> DataFrame:
    """df's postings as (part, keys, nodes, marks): blocks of little-endian 64-bit numbers, dealt by part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["part", "keys", "nodes", "marks"]

    def blocks(held: list[Postings]) -> pa.RecordBatch:
        keys, nodes, marks = (np.concatenate(x) for x in zip(*held))
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 65536 else np.uint32)
        order = np.argsort(part, kind="stable")
        which, starts = np.unique(part[order], return_index=True)
        stops = np.append(starts[1:], len(order))
        columns = [[x[order[a:b]].tobytes() for a, b in zip(starts, stops)] for x in (keys, nodes, marks)]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Postings] = []
        size = 0
        for some in postings(batches):
            held.append(some)
            size += len(some[0])
            if size >= PACKED:
                yield blocks(held)
                held, size = [], 0
        if size:
            yield blocks(held)

    return df.mapInArrow(run, "part int, keys binary, nodes binary, marks binary").repartitionById(parts, F.col("part"))


def listed(blocks: DataFrame, fits: Fits, short: int | None = None) -> DataFrame:
    """(key, node, lead, mark) of packed postings: keys with more than SHORT fitting nodes, each node once (if HELD suffices), lead being the list's first node, null for itself and where the marks do not fit; and pairs (node, lead) of shorter lists, without key, each once a worker.

    short=0 gives all lists by key."""

    short = SHORT if short is None else short

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: Postings = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held: list[Postings] = [first]
        size, whole = 0, True
        for batch in batches:
            for keys, nodes, marks in zip(*(batch.column(i) for i in (1, 2, 3))):
                held.append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(nodes.as_buffer(), np.int64), np.frombuffer(marks.as_buffer(), np.int64)))
                size += len(held[-1][0])
                if size >= HELD:
                    first, out = _collapsed(held, any_marks, 0)  # a key's later nodes must still find it
                    yield from out
                    held, size, whole = [first], 0, False
        yield from _collapsed(held, fits if whole else any_marks, short if whole else 0)[1]

    return blocks.mapInArrow(run, "key long, node long, lead long, mark long")


def _collapsed(held: list[Postings], fits: Fits, short: int) -> tuple[Postings, Iterator[pa.RecordBatch]]:
    """The first node of each key, and the lists; held starts with the first nodes so far."""
    keys, nodes, marks = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(keys, kind="stable")
    keys, nodes, marks = keys[order], nodes[order], marks[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    first = keys[starts], nodes[starts], marks[starts]
    sizes = np.diff(np.append(starts, len(keys)))
    shared = np.logical_or.reduceat(nodes != np.repeat(first[1], sizes), starts) if len(keys) else np.zeros(0, bool)
    keep = np.repeat(shared, sizes)
    return first, _lists(keys[keep], nodes[keep], marks[keep], fits, short)


def _lists(keys: np.ndarray, nodes: np.ndarray, marks: np.ndarray, fits: Fits, short: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((nodes, keys))
    keys, nodes, marks = keys[order], nodes[order], marks[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
    keys, nodes, marks = keys[fresh], nodes[fresh], marks[fresh]
    if fits is not any_marks and len(keys):
        live = fitting(keys, lambda i, j: fits(marks[i], marks[j]))
        keys, nodes, marks = keys[live], nodes[live], marks[live]
    if not len(keys):
        return
    sizes, after = _extents(keys)
    pairs = [np.zeros((2, 0), np.int64)]
    for by in range(1, short):
        i = np.flatnonzero((sizes <= short) & (after >= by))
        i = i[fits(marks[i], marks[i + by])]
        pairs.append(np.stack([nodes[i], nodes[i + by]]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    for a in range(0, pairs.shape[1], 1 << 18):
        some = pairs[:, a : a + (1 << 18)]
        none = pa.nulls(some.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(some[0]), pa.array(some[1]), none], names=["key", "node", "lead", "mark"])
    long = sizes > short
    keys, nodes, marks = keys[long], nodes[long], marks[long]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    at = np.repeat(starts, np.diff(np.append(starts, len(keys))))
    led = (nodes != nodes[at]) & fits(marks, marks[at])
    for a in range(0, len(keys), 1 << 18):
        part = slice(a, a + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(nodes[part]), pa.array(nodes[at][part], mask=~led[part]), pa.array(marks[part])], names=["key", "node", "lead", "mark"])


def fitting(groups: np.ndarray, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which rows fit another row of their group, by pairs(i, j). Rows of a group stand together; groups beyond FILTERED fit whole."""
    sizes, after = _extents(groups)
    live = sizes > FILTERED
    rows = np.flatnonzero((after > 0) & ~live)
    by = 1
    while len(rows):
        for i in np.split(rows, range(1 << 17, len(rows), 1 << 17)):
            i = i[~(live[i] & live[i + by])]
            hit = pairs(i, i + by)
            live[i[hit]] = live[i[hit] + by] = True
        by += 1
        rows = rows[after[rows] >= by]
    return live


def _extents(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the size of its group, and the rows of it that follow."""
    n = len(groups)
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    return np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes) - np.arange(n) - 1


def candidates(groups: np.ndarray, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of a group that fit, and which rows are in a group with more than DENSE fitting pairs a row; of such groups no pairs."""
    sizes, after = _extents(groups)
    n = len(groups)
    counts = np.zeros(int(groups[-1]) + 1 if n else 0, np.int64)
    dense = np.zeros(len(counts), bool)
    live = np.zeros(n, bool)
    held: list[np.ndarray] = []
    rows = np.flatnonzero(after > 0)
    by = 1
    while len(rows):
        for i in np.split(rows, range(1 << 17, len(rows), 1 << 17)):
            i = i[~dense[groups[i]] | ~live[i] | ~live[i + by]]
            i = i[pairs(i, i + by)]
            if not len(i):
                continue
            live[i] = live[i + by] = True
            held.append(np.stack([i, i + by]))
            counts += np.bincount(groups[i], minlength=len(counts))
            dense[groups[i]] |= counts[groups[i]] > DENSE * sizes[i]
        by += 1
        rows = rows[after[rows] >= by]
        if len(held) > 64:
            held = [x[:, ~dense[groups[x[0]]]] for x in [np.concatenate(held, axis=1)]]
    found = np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1)
    found = found[:, ~dense[groups[found[0]]]]
    return found[0], found[1], live & dense[groups] if n else live


def shared_lists(postings: DataFrame) -> DataFrame:
    """(key, node, lead, mark) of postings(key, node): keys with at least two nodes, each pair once."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
        for batch in batches:
            key, node = (batch.column(i).to_numpy() for i in range(2))
            yield key.view(np.uint64), node, np.zeros(len(key), np.int64)

    return listed(packed(postings.select("key", "node"), unpacked), any_marks, 0)


#: Words of the parity bitmap. Its 1024 classes tell sets of up to 1024 elements apart; larger ones have a wide one besides, of at least as many classes as elements (a power of two, so that a wider one folds into a narrower).
WORDS = 16
SKETCH = [f"s{i}" for i in range(WORDS)]


def parity(hashes: np.ndarray) -> list[int]:
    """Of distinct elements' hashes: how many there are, and the words of their parity."""
    odd = np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return [len(hashes), *np.packbits(odd.astype(bool)).view("<i8").tolist()]


def wide_parity(hashes: np.ndarray) -> list[int] | None:
    """The wide bitmap's words; null where the narrow one is enough."""
    n = len(hashes)
    if n <= 64 * WORDS:
        return None
    classes = 1 << (n - 1).bit_length()
    odd = np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool)).view("<i8").tolist()


def wide_differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two wide bitmaps differ, the wider one folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _differing(a: Column, b: Column) -> Column:
    """wide_differing on columns; sizes that fit differ by a factor of two at most."""

    def folded(x: Column, size: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > size, halves).otherwise(x)

    size = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, size), folded(b, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def may_link(other: str = "o_") -> Column:
    """The bounds on sizes and differing elements of a pair in columns n, s0.., wide and the same behind a prefix."""
    n, m = F.col("n"), F.col(f"{other}n")
    differing = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"{other}{s}"))) for s in SKETCH), F.lit(0))
    bounded = lambda d: d * (100 + SIMILAR) <= (n + m) * (100 - SIMILAR)
    wide, other_wide = F.col("wide"), F.col(f"{other}wide")
    near = F.when(wide.isNotNull() & other_wide.isNotNull(), bounded(_differing(wide, other_wide))).otherwise(True)
    return F.when((F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR) & bounded(differing), near).otherwise(False)


def similar(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of pairs of sets as (hashes of all, how many each has), at most 256: which are similar. Elements count as equal if 56 bits of their hashes are."""

    def sets(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mine = np.sort(np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(56), counts) | hashes >> np.uint64(8))
        return mine[np.append(True, mine[1:] != mine[:-1])[: len(mine)]]

    a, b = sets(*left), sets(*right)
    n = len(left[1])
    number = lambda x: np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=n)
    every = np.sort(np.concatenate([a, b]))
    both = number(every[1:][every[1:] == every[:-1]])
    return (both > 0) & (100 * both >= SIMILAR * (number(a) + number(b) - both))


def verify(pairs: DataFrame, contents: Contents, decode: Decode) -> DataFrame:
    """The (a, b) of pairs (a written table) whose sets are similar."""
    known = fetched(contents, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    joined = pairs.join(known.withColumnsRenamed({"node": "b", "content": "right"}), "b").join(known.withColumnsRenamed({"node": "a", "content": "left"}), "a").select("a", "b", "left", "right")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, ("left", "right")):
                keep = similar(decode(part.column("left")), decode(part.column("right")))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Of at most 256 rows and about that many bytes in the columns, one row at least."""
    sizes = sum(np.diff(_offsets(batch.column(c))) for c in columns)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 256]), limit, "right")))
        yield batch.slice(at, n)
        at += n


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def fetched(contents: Contents, nodes: DataFrame) -> DataFrame:
    """(node, content) of at least these nodes: all there are, or a written table of just these."""
    if isinstance(contents, DataFrame):
        return contents.select("node", "content")
    return materialize(contents(materialize(nodes.select("node").distinct(), "named")), "contents").select("node", "content")


def fewer(nodes: DataFrame) -> DataFrame:
    """nodes, marked for broadcast if they are few."""
    return F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes


def only(df: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """The rows of df whose column is among nodes(node): broadcast if there are few, else a shuffled join."""
    return df.join(fewer(nodes).withColumnRenamed("node", column), column, "left_semi")


def join_sized(rows: DataFrame, keyed: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with keyed (written, one row a key, with its number of rows in size). Keys with over HOT of all rows are broadcast (there are at most 1 / HOT), so none meets in one task."""
    total = keyed.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(keyed.filter(F.col(size) > HOT * total))
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.filter(F.col(size) <= HOT * total), key)
    return rows.join(hot, key).unionByName(cold)


class _Groups:
    """Collects the rows of whole groups (key, low, high) from sorted batches."""

    NAMES = ("key", "low", "high")

    def __init__(self, batches: Iterator[pa.RecordBatch], rows: int) -> None:
        self.batches, self.rows = batches, rows

    def __iter__(self) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables of whole groups, about so many rows, and the number of each row's group."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in self.batches:
            held.append(batch)
            size += batch.num_rows
            if size >= self.rows:
                table = pa.Table.from_batches(held)
                group = self.groups(table)
                cut = int(np.searchsorted(group, group[-1]))  # the last may go on
                if cut:
                    yield table.slice(0, cut), group[:cut]
                held = table.slice(cut).to_batches()
                size = len(table) - cut
        if size:
            table = pa.Table.from_batches(held)
            yield table, self.groups(table)

    def groups(self, table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for name in self.NAMES:
            x = table.column(name).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)


def grouped(rest: DataFrame) -> DataFrame:
    """rest (key, node, part, length, ...): each row once for every block of its list, with low and high, the two blocks, and own, its own."""
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "length")


def _may_meet(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether rows i and j are of different components and, in a group of two blocks, of different blocks."""
    part, own, low, high = (table.column(c).to_numpy() for c in ("part", "own", "low", "high"))
    return lambda i, j: (part[i] != part[j]) & ((low[i] == high[i]) | (own[i] != own[j]))


def across(groups: DataFrame, fits: Fits) -> DataFrame:
    """Rows (key, low, high, own, node, mark, other) of nodes that may link a node of another component of their group: pairs with other, and all such nodes of dense groups without."""
    names = ["key", "low", "high", "own", "node", "mark"]
    sketched = [c for c in SKETCH if c in groups.columns]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _Groups(batches, 1 << 15):
            meet, mark, node = _may_meet(table), table.column("mark").to_numpy(), table.column("node").to_numpy()
            words = np.column_stack([table.column(c).to_numpy().view(np.uint64) for c in sketched]) if sketched else None
            wide = table.column("wide").combine_chunks() if sketched else None
            ends, flat = (wide.offsets.to_numpy(), wide.values.to_numpy()) if sketched else (None, None)

            def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                hit = meet(i, j) & fits(mark[i], mark[j])
                if words is not None and hit.any():
                    at = np.flatnonzero(hit)
                    i, j = i[at], j[at]
                    differing = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64)
                    hit[at] = differing * (100 + SIMILAR) <= (mark[i] + mark[j]) * (100 - SIMILAR)
                    both = hit[at] & (ends[i + 1] > ends[i]) & (ends[j + 1] > ends[j])
                    for k in np.flatnonzero(both).tolist():
                        a, b = (flat[ends[x[k]] : ends[x[k] + 1]] for x in (i, j))
                        hit[at[k]] = wide_differing(a, b) * (100 + SIMILAR) <= (mark[i[k]] + mark[j[k]]) * (100 - SIMILAR)
                return hit

            i, j, dense = candidates(group, pairs)
            rows = table.select(names)
            if len(i):
                a, b = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
                none = {c: pa.nulls(len(a), rows.schema.field(c).type) for c in names}
                yield from pa.table(none | {"node": pa.array(a), "other": pa.array(b)}).to_batches()
            if dense.any():
                kept = rows.filter(pa.array(dense))
                yield from pa.table({c: kept.column(c) for c in names} | {"other": pa.nulls(len(kept), pa.int64())}).combine_chunks().to_batches()

    dealt = groups.select(*names, "part", *sketched, *(["wide"] if sketched else [])).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return dealt.mapInArrow(run, "key long, low int, high int, own int, node long, mark long, other long")


def tied(rows: DataFrame, fits: Fits, decode: Decode) -> DataFrame:
    """Links (a, b) that tie the components of each group's rows (key, low, high, own, node, part, mark, content)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _Groups(batches, BLOCK):
            meet, mark = _may_meet(table), table.column("mark").to_numpy()
            part, node = (table.column(c).to_numpy() for c in ("part", "node"))
            content = table.column("content").combine_chunks()
            starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
            found: list[tuple[int, int]] = []
            for begin, end in zip(starts, starts[1:]):
                found += _spanned(begin, end, meet, lambda i, j: fits(mark[i], mark[j]), part, content, decode)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _spanned(begin: int, end: int, meet: Callable, fits: Callable, part: np.ndarray, content: pa.Array, decode: Decode) -> Iterator[tuple[int, int]]:
    """The links of a spanning forest over the components of one group's rows."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    sets: dict[int, np.ndarray] = {}

    def elements(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(decode(content.slice(i, 1))[0])
        return sets[i]

    rows = np.arange(begin, end)
    for i in range(begin, end):
        after = rows[i + 1 - begin :]
        at = np.full(len(after), i)
        others = after[meet(at, after) & fits(at, after)]
        for k in range(0, len(others), TOGETHER):
            own = root(int(part[i]))
            some = [j for j in others[k : k + TOGETHER].tolist() if root(int(part[j])) != own]
            if not some:
                continue
            x, each = elements(i), [elements(j) for j in some]
            sizes = np.array([len(y) for y in each])
            every = np.concatenate(each)
            same = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
            both = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
            for j in np.array(some)[(both > 0) & (100 * both >= SIMILAR * (len(x) + sizes - both))].tolist():
                a, b = root(int(part[i])), root(int(part[j]))
                if a != b:
                    above[max(a, b)] = min(a, b)
                    yield i, j
        sets.pop(i, None)


def listed_nodes(lists: DataFrame) -> DataFrame:
    """(node) of all nodes in lists and pairs."""
    return lists.select("node").union(lists.filter("lead is not null").select("lead")).distinct()


def link(lists: DataFrame, fits: Fits, contents: Contents, decode: Decode, sketches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found and components (id, component) of the nodes they tie.

    lists: of listed(), a written table. decode gives the sets of a column of contents. sketches: (node, n, s0.., wide), n being the mark as well."""
    pairs = lists.filter("lead is not null").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    if sketches is not None:
        named = materialize(listed_nodes(lists), "nodes")
        sketches = materialize(only(sketches, named).dropDuplicates(["node"]), "sketches")
        if sketches.count() <= BROADCAST_SKETCHES:
            sketches = F.broadcast(sketches)
        right = sketches.select(F.col("node").alias("b"), *(F.col(c).alias(f"o_{c}") for c in ("n", *SKETCH, "wide")))
        pairs = materialize(pairs, "named").join(sketches.withColumnRenamed("node", "a"), "a").join(right, "b").filter(may_link()).select("a", "b")
    tried = materialize(pairs, "tried")
    links = materialize(verify(tried, contents, decode), "links")
    parts = materialize(connected_components(links), "parts")
    placed = materialize(placed_in(lists.filter("key is not null").select("key", "node", "mark"), parts), "placed")
    spans = materialize(placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("length")).filter("low != high").select("key", "length"), "spans")
    rest = grouped(join_sized(placed, spans, "key", "length"))
    if sketches is not None:
        rest = rest.join(sketches.select("node", *SKETCH, "wide"), "node")
    found = materialize(across(rest, fits), "across")
    pairs = materialize(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links, parts = _joined(links, parts, materialize(verify(pairs, contents, decode), "links"))
    dense = placed_in(found.filter("other is null").drop("other"), parts)
    spans = dense.groupBy("key", "low", "high").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least != most").select("key", "low", "high")
    dense = materialize(dense.join(spans, ["key", "low", "high"]), "dense")
    if not dense.isEmpty():
        rows = dense.join(fetched(contents, dense), "node")
        links, parts = _joined(links, parts, materialize(tied(rows, fits, decode), "links"))
    return links, parts


def placed_in(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (node, ...) with part, the component of the node."""
    return rows.join(fewer(parts).withColumnsRenamed({"id": "node", "component": "part"}), "node", "left").withColumn("part", F.coalesce("part", "node"))


def _joined(links: DataFrame, parts: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components after more links: what is joined already enters as stars, so few rounds are left."""
    if more.isEmpty():
        return links, parts
    stars = parts.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return links.union(more), materialize(connected_components(stars.union(more)), "parts")
