"""The level-of-detail model file: header, node, patch and texture records, then padded payloads.

  header 88 bytes | nodes 44 each | patches 12 each | textures 68 each | payloads, each padded to 256
Node payloads are planar: positions f32 x 3, normals i16 x 3, colours u8 x 4, faces u16 x 3. In a
compressed file (a flag of this library's own in the signature) a payload is a step exponent, the
least quantised position and the mesh as operators.payload codes it, faces grouped by patch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import payload

# Fixed values of the format.
MAGIC = 0x4E787320
PADDING = 256
NO_TEXTURE = 0xFFFFFFFF
COMPRESSED = 1 << 16
COMPRESSED_HEAD = struct.Struct("<iIqqq")
HEADER = struct.Struct("<IIQQ36sIII4f")
NODE = np.dtype([("offset", "<u4"), ("nvert", "<u2"), ("nface", "<u2"), ("error", "<f4"), ("cone", "<i2", 4), ("sphere", "<f4", 4), ("tight_radius", "<f4"), ("first_patch", "<u4")])
PATCH = np.dtype([("node", "<u4"), ("triangle_offset", "<u4"), ("texture", "<u4")])
TEXTURE = np.dtype([("offset", "<u4"), ("matrix", "<f4", 16)])
#: Attribute types of the signature: bytes of each code.
TYPE_SIZES = (0, 1, 1, 2, 2, 4, 4, 4, 8)


class Header(NamedTuple):
    version: int
    nvert: int
    nface: int
    signature: bytes
    n_nodes: int
    n_patches: int
    n_textures: int
    sphere: tuple[float, ...]


def pad(n: int) -> int:
    return -(-n // PADDING) * PADDING


def attributes(signature: bytes) -> dict[str, list[tuple[int, int]]]:
    """(type, count) of the eight vertex and eight face slots."""
    pairs = [(signature[i], signature[i + 1]) for i in range(0, 32, 2)]
    return {"vertex": pairs[:8], "face": pairs[8:]}


def signature(normals: bool = False, colours: bool = False, compressed: bool = False) -> bytes:
    slots = [(7, 3), (3, 3) if normals else (0, 0), (2, 4) if colours else (0, 0)] + [(0, 0)] * 5 + [(4, 3)] + [(0, 0)] * 7
    return b"".join(bytes(s) for s in slots) + struct.pack("<I", COMPRESSED * compressed)


def is_compressed(sig: bytes) -> bool:
    return bool(struct.unpack("<I", sig[32:])[0] & COMPRESSED)


def compress_payload(points: np.ndarray, faces: np.ndarray, ends: np.ndarray, exponent: int) -> bytes:
    """A node's mesh at steps of 2^exponent; ends: where the faces of each patch end."""
    q = np.floor(points.astype(np.float64) / 2.0**exponent + 0.5).astype(np.int64)
    low = q.min(axis=0) if len(q) else np.zeros(3, np.int64)
    groups = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    coded = payload.encode_mesh(q - low, faces.astype(np.int64), groups)
    return COMPRESSED_HEAD.pack(exponent, len(coded), *low.tolist()) + coded


def expand_payload(raw: bytes) -> dict[str, np.ndarray]:
    """points and faces of a compressed payload, the faces of each patch together."""
    exponent, size, *low = COMPRESSED_HEAD.unpack_from(raw)
    coded = raw[COMPRESSED_HEAD.size : COMPRESSED_HEAD.size + size]  # padding follows
    points, faces = payload.decode_mesh(coded)
    order = np.argsort(payload.decode_groups(coded), kind="stable")
    return {"points": (points + np.array(low)) * 2.0**exponent, "faces": faces[order]}


def pack_payload(points: np.ndarray, faces: np.ndarray, normals: np.ndarray | None = None, colours: np.ndarray | None = None) -> bytes:
    parts = [points.astype("<f4").tobytes()]
    if normals is not None:
        parts.append(np.round(normals * 32766).astype("<i2").tobytes())
    if colours is not None:
        parts.append(colours.astype("u1").tobytes())
    return b"".join([*parts, faces.astype("<u2").tobytes()])


def unpack_payload(raw: bytes, nvert: int, nface: int, sig: bytes) -> dict[str, np.ndarray]:
    slots = attributes(sig)["vertex"]
    out = {"points": np.frombuffer(raw, "<f4", 3 * nvert).reshape(-1, 3)}
    at = 12 * nvert
    if slots[1][0]:
        out["normals"] = np.frombuffer(raw, "<i2", 3 * nvert, at).reshape(-1, 3) / 32766.0
        at += 6 * nvert
    if slots[2][0]:
        out["colours"] = np.frombuffer(raw, "u1", 4 * nvert, at).reshape(-1, 4)
        at += 4 * nvert
    out["faces"] = np.frombuffer(raw, "<u2", 3 * nface, at).reshape(-1, 3)
    return out


def write(path: str, header: Header, nodes: np.ndarray, patches: np.ndarray, payloads: Iterator[bytes], lengths: np.ndarray | None = None) -> None:
    """nodes without the sink and without offsets; payloads in node order, one at a time, and their lengths if they are compressed."""
    index = HEADER.size + (len(nodes) + 1) * NODE.itemsize + len(patches) * PATCH.itemsize
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    sig = attributes(header.signature)
    width = 12 + 6 * bool(sig["vertex"][1][0]) + 4 * bool(sig["vertex"][2][0])
    if lengths is None:
        lengths = nodes["nvert"].astype(np.int64) * width + nodes["nface"].astype(np.int64) * 6
    sizes = -(-np.asarray(lengths, np.int64) // PADDING) * PADDING
    ends = pad(index) + np.cumsum(sizes)
    table = np.zeros(len(nodes) + 1, NODE)
    table[:-1] = nodes
    table["offset"] = np.concatenate([[pad(index)], ends]) // PADDING
    table[-1]["first_patch"] = len(patches)
    with store.open_output_stream(where) as out:
        out.write(HEADER.pack(MAGIC, header.version, header.nvert, header.nface, header.signature, len(nodes) + 1, len(patches), 0, *header.sphere))
        out.write(table.tobytes() + patches.tobytes())
        out.write(b"\0" * (pad(index) - index))
        for raw, size in zip(payloads, sizes.tolist(), strict=True):
            out.write(raw + b"\0" * (size - len(raw)))


class ModelFile:
    """Index of a file, and byte ranges of it: only what is asked for is read."""

    def __init__(self, path: str) -> None:
        self.store, self.where = fs.FileSystem.from_uri(path)
        raw = self.range(0, HEADER.size)
        magic, *rest = HEADER.unpack(raw)
        if magic != MAGIC:
            raise ValueError("not a model file")
        self.header = Header(*rest[:7], tuple(rest[7:]))
        h = self.header
        size = h.n_nodes * NODE.itemsize + h.n_patches * PATCH.itemsize + h.n_textures * TEXTURE.itemsize
        raw = self.range(HEADER.size, HEADER.size + size)
        self.nodes = np.frombuffer(raw, NODE, h.n_nodes)
        self.patches = np.frombuffer(raw, PATCH, h.n_patches, h.n_nodes * NODE.itemsize)
        self.textures = np.frombuffer(raw, TEXTURE, h.n_textures, h.n_nodes * NODE.itemsize + h.n_patches * PATCH.itemsize)

    def range(self, begin: int, end: int) -> bytes:
        with self.store.open_input_file(self.where) as f:
            return f.read_at(end - begin, begin)

    def roots(self) -> int:
        """Nodes before the least destination are roots."""
        return int(self.patches["node"].min()) if len(self.patches) else len(self.nodes)

    def payload(self, node: int) -> dict[str, np.ndarray]:
        n = self.nodes[node]
        raw = self.range(int(n["offset"]) * PADDING, int(self.nodes[node + 1]["offset"]) * PADDING)
        if is_compressed(self.header.signature):
            return expand_payload(raw)
        return unpack_payload(raw, int(n["nvert"]), int(n["nface"]), self.header.signature)


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, error, cx.. radius, tight_radius, nvert, nface, first_patch, bytes) and patches (patch, src, dst, tri_begin, tri_end)."""
    f = ModelFile(path)
    n, p = f.nodes[:-1], f.patches
    first = f.nodes["first_patch"].astype(np.int64)
    owner = np.repeat(np.arange(len(n)), np.diff(first))
    ends = p["triangle_offset"].astype(np.int64)
    begins = np.where(np.arange(len(p)) == first[owner], 0, np.roll(ends, 1))
    import pandas as pd

    nodes = pd.DataFrame({"node": np.arange(len(n)), "error": n["error"].astype(float), "cx": n["sphere"][:, 0].astype(float), "cy": n["sphere"][:, 1].astype(float), "cz": n["sphere"][:, 2].astype(float), "radius": n["sphere"][:, 3].astype(float), "tight_radius": n["tight_radius"].astype(float), "nvert": n["nvert"].astype(np.int64), "nface": n["nface"].astype(np.int64), "first_patch": n["first_patch"].astype(np.int64), "bytes": np.diff(f.nodes["offset"].astype(np.int64)) * PADDING})
    patches = pd.DataFrame({"patch": np.arange(len(p)), "src": owner, "dst": p["node"].astype(np.int64), "tri_begin": begins, "tri_end": ends})
    return spark.createDataFrame(nodes), spark.createDataFrame(patches)


def read_triangles(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """(node, tri, x0..z2) of the chosen nodes(node): each task reads only their ranges."""
    from lodestone.sources.binary_meshes import CORNERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = ModelFile(path)
        for batch in batches:
            for node in batch.column("node").to_pylist():
                got = f.payload(node)
                c = got["points"][got["faces"].astype(np.int64)].reshape(-1, 9).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), node)), pa.array(np.arange(len(c))), *(pa.array(c[:, k].copy()) for k in range(9))], names=["node", "tri", *CORNERS])

    return nodes.select("node").mapInArrow(run, "node long, tri long, " + ", ".join(f"{c} double" for c in CORNERS))


def read_patch_triangles(spark: SparkSession, path: str, nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(node, dst, x0..z2): triangles with the destination of their patch, by the patch's range."""
    from lodestone.sources.binary_meshes import CORNERS

    each = read_triangles(spark, path, nodes)
    ranges = patches.select(F.col("src").alias("node"), "dst", F.explode(F.sequence("tri_begin", F.col("tri_end") - 1)).alias("tri"))
    return each.join(ranges, ["node", "tri"]).select("node", "dst", *CORNERS)


def read_node_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, payload) of one file a node."""
    return spark.read.format("binaryFile").load(f"{folder}/*.node").select(F.regexp_extract("path", r"(\d+)\.node$", 1).cast("long").alias("id"), F.col("content").alias("payload"))


def expanded_triangles(packed: DataFrame) -> DataFrame:
    """(id, tri, x0..z2) of compressed payloads (id, payload)."""
    from lodestone.sources.binary_meshes import CORNERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column("id").to_pylist(), batch.column("payload").to_pylist()):
                got = expand_payload(raw)
                c = got["points"][got["faces"]].reshape(-1, 9)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), node)), pa.array(np.arange(len(c))), *(pa.array(c[:, k].copy()) for k in range(9))], names=["id", "tri", *CORNERS])

    return packed.select("id", "payload").mapInArrow(run, "id long, tri long, " + ", ".join(f"{c} double" for c in CORNERS))
