"""Compressed node payloads: point clouds by Morton order, meshes by a growing front with parallelogram prediction.

Both work on quantised coordinates of one node and run a node a row on the executors.
  cloud: points sorted by Morton code, equal ones once; for each the highest bit that differs from
    the code before (Tunstall words) and the bits below it
  mesh: gates (directed edges) are taken in order; a gate meets a border, a new vertex, or a vertex
    already coded; new vertices are coded as differences from the parallelogram of the gate
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.operators.codec import BitReader, BitWriter, Tunstall, read_differences, write_differences

BORDER, NEW, KNOWN = 0, 1, 2


def _pack(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _unpack(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack_symbols(symbols: Sequence[int]) -> bytes:
    """A histogram and the words; symbols are small."""
    counts = np.bincount(np.array(symbols, np.int64), minlength=1) if len(symbols) else np.zeros(0, np.int64)
    code = Tunstall([s for s, n in enumerate(counts.tolist()) for _ in range(n)])
    return _pack(struct.pack("<I", len(symbols)), counts.astype("<u4").tobytes(), code.encode(symbols))


def unpack_symbols(raw: bytes) -> list[int]:
    n, counts, words = _unpack(raw)
    code = Tunstall([s for s, k in enumerate(np.frombuffer(counts, "<u4").tolist()) for _ in range(k)])
    return code.decode(words, int.from_bytes(n, "little"))


def morton_codes(points: np.ndarray) -> list[int]:
    """Codes of non-negative coordinates of at most 21 bits."""
    out = np.zeros(len(points), np.uint64)
    for bit in range(21):
        for axis in range(3):
            out |= (points[:, axis].astype(np.uint64) >> np.uint64(bit) & np.uint64(1)) << np.uint64(3 * bit + axis)
    return out.tolist()


def encode_cloud(points: np.ndarray) -> bytes:
    codes = sorted(set(morton_codes(points)))
    tops, bits, before = [], BitWriter(), 0
    for code in codes:
        top = (code ^ before).bit_length()  # 0 only for a first code of 0
        tops.append(top)
        if top:
            bits.put(code, top - 1)
        before = code
    return _pack(pack_symbols(tops), bits.bytes())


def decode_cloud(raw: bytes) -> np.ndarray:
    symbols, rest = _unpack(raw)
    bits, code, out = BitReader(rest), 0, []
    for top in unpack_symbols(symbols):
        if top:  # the bit flips from 0 to 1: codes ascend
            code = (code >> top << top) | 1 << (top - 1) | bits.take(top - 1)
        out.append(code)
    points = np.zeros((len(out), 3), np.int64)
    codes = np.array(out, np.uint64)
    for bit in range(21):
        for axis in range(3):
            points[:, axis] |= ((codes >> np.uint64(3 * bit + axis) & np.uint64(1)) << np.uint64(bit)).astype(np.int64)
    return points


def _front(faces: np.ndarray) -> Iterator[tuple]:
    """The coder's walk: ("start", corners, face), or (gate, symbol, vertex, face)."""
    across: dict[tuple[int, int], list[int]] = {}
    for f, (a, b, c) in enumerate(faces.tolist()):
        for edge in ((a, b), (b, c), (c, a)):
            across.setdefault(edge, []).append(f)
    done = np.zeros(len(faces), bool)
    for seed in range(len(faces)):
        if done[seed]:
            continue
        done[seed] = True
        a, b, c = faces[seed].tolist()
        yield "start", (a, b, c), seed
        gates = [(a, b, c), (b, c, a), (c, a, b)]
        at = 0
        while at < len(gates):
            a, b, behind = gates[at]
            at += 1
            beyond = next((f for f in across.get((b, a), ()) if not done[f]), None)
            if beyond is None:
                yield (a, b, behind), BORDER, None, None
                continue
            done[beyond] = True
            corners = faces[beyond].tolist()
            k = corners.index(b)
            apex = corners[(k + 2) % 3]
            yield (a, b, behind), None, apex, beyond
            gates += [(a, apex, b), (apex, b, a)]


def encode_mesh(points: np.ndarray, faces: np.ndarray, groups: np.ndarray | None = None) -> bytes:
    """points: whole numbers; faces: corners without repeats; groups: a number below 65536 for each face. Vertices and faces are renumbered in the order they are met; unused vertices go."""
    order: list[int] = []
    number: dict[int, int] = {}
    symbols: list[int] = []
    known = BitWriter()
    differences: list[int] = []
    width = max(1, len(points).bit_length())

    def meet(v: int, guess: np.ndarray) -> None:
        if v in number:
            symbols.append(KNOWN)
            known.put(number[v], width)
        else:
            symbols.append(NEW)
            number[v] = len(number)
            differences.extend((points[v] - guess).tolist())

    last = np.zeros(3, np.int64)
    for gate, symbol, *rest in _front(faces):
        if gate == "start":
            order.append(rest[0])
            for v in symbol:
                meet(v, last)
                last = points[v]
        elif symbol == BORDER:
            symbols.append(BORDER)
        else:
            a, b, behind = gate
            order.append(rest[1])
            meet(rest[0], points[a] + points[b] - points[behind])
    sizes, bits = write_differences(differences)
    grouped = [] if groups is None else [zlib.compress(np.asarray(groups, "<u2")[order].tobytes())]
    return _pack(struct.pack("<III", len(faces), len(number), width), pack_symbols(symbols), known.bytes(), pack_symbols(sizes), bits, *grouped)


def decode_groups(raw: bytes) -> np.ndarray:
    """The groups of a mesh's faces, in the order in which decode_mesh gives these."""
    return np.frombuffer(zlib.decompress(_unpack(raw)[5]), "<u2").astype(np.int64)


def decode_mesh(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, symbols, known, sizes, bits = _unpack(raw)[:5]
    n_faces, _, width = struct.unpack("<III", head)
    values = iter(read_differences(unpack_symbols(sizes), bits))
    kinds, refs = iter(unpack_symbols(symbols)), BitReader(known)
    points: list[np.ndarray] = []
    faces: list[tuple[int, int, int]] = []

    def meet(kind: int, guess: np.ndarray) -> int:
        if kind == KNOWN:
            return refs.take(width)
        points.append(guess + np.array([next(values) for _ in range(3)], np.int64))
        return len(points) - 1

    last = np.zeros(3, np.int64)
    while len(faces) < n_faces:
        corners = []
        for _ in range(3):
            corners.append(meet(next(kinds), last))
            last = points[corners[-1]]
        a, b, c = corners
        faces.append((a, b, c))
        gates, at = [(a, b, c), (b, c, a), (c, a, b)], 0
        while at < len(gates):
            a, b, behind = gates[at]
            at += 1
            kind = next(kinds)
            if kind == BORDER:
                continue
            apex = meet(kind, points[a] + points[b] - points[behind])
            faces.append((b, a, apex))
            gates += [(a, apex, b), (apex, b, a)]
    return np.array(points, np.int64).reshape(-1, 3), np.array(faces, np.int64).reshape(-1, 3)


def compress_clouds(points: DataFrame) -> DataFrame:
    """points (node, qx, qy, qz) to (node, n, payload): a node's quantised points, which its capacity bounds."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        q = np.column_stack([rows.column(c).to_numpy() for c in ("qx", "qy", "qz")]).astype(np.int64)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(q)], pa.int64()), "payload": pa.array([encode_cloud(q)], pa.binary())})

    return points.select("node", "qx", "qy", "qz").groupBy("node").applyInArrow(run, "node long, n long, payload binary")


def decompress_clouds(nodes: DataFrame) -> DataFrame:
    """(node, qx, qy, qz) of compressed payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("payload").to_pylist()):
                q = decode_cloud(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), node)), *(pa.array(q[:, k].copy()) for k in range(3))], names=["node", "qx", "qy", "qz"])

    return nodes.select("node", "payload").mapInArrow(run, "node long, qx long, qy long, qz long")
