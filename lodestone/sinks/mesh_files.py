"""Mesh files from tables: records are packed on the executors, the driver only joins them in order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.binary_meshes import CORNERS, STL_RECORD


def _open(path: str) -> pa.NativeFile:
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    return store.open_output_stream(where)


def _write(packed: DataFrame, path: str, head: bytes) -> None:
    """packed: (raw) in the order of its partitions; parts are fetched one after the other."""
    with _open(path) as out:
        out.write(head)
        for row in packed.toLocalIterator():
            out.write(bytes(row["raw"]))


def write_stl(soup: DataFrame, path: str) -> int:
    """Binary STL with face normals; the number of triangles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CORNERS])
            a, b, c = v[:, :3], v[:, 3:6], v[:, 6:]
            n = np.cross(b - a, c - a)
            length = np.linalg.norm(n, axis=1, keepdims=True)
            records = np.zeros(len(v), STL_RECORD)
            records["v"] = v
            records["normal"] = n / np.where(length > 0, length, 1)
            yield pa.RecordBatch.from_arrays([pa.array([records.tobytes()], pa.binary())], names=["raw"])

    n = soup.count()
    _write(soup.select(*CORNERS).mapInArrow(pack, "raw binary"), path, b"\0" * 80 + struct.pack("<I", n))
    return n


def write_ply(verts: DataFrame, faces: DataFrame, path: str) -> None:
    """Binary PLY of verts (id, x, y, z), dense from 0, and faces (i0, i1, i2)."""

    def pack_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"]).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["raw"])

    def pack_faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record = np.zeros(batch.num_rows, np.dtype([("n", "u1"), ("i", "<i4", 3)]))
            record["n"] = 3
            record["i"] = np.column_stack([batch.column(f"i{k}").to_numpy() for k in range(3)])
            yield pa.RecordBatch.from_arrays([pa.array([record.tobytes()], pa.binary())], names=["raw"])

    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {verts.count()}\nproperty float x\nproperty float y\nproperty float z\nelement face {faces.count()}\nproperty list uchar int vertex_indices\nend_header\n"
    ordered = verts.repartitionByRange("id").sortWithinPartitions("id").select("x", "y", "z").mapInArrow(pack_points, "raw binary")
    with _open(path) as out:
        out.write(head.encode())
        for part in (ordered, faces.select("i0", "i1", "i2").mapInArrow(pack_faces, "raw binary")):
            for row in part.toLocalIterator():
                out.write(bytes(row["raw"]))


def unified(faces: DataFrame, verts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faces (tri, i0, i1, i2) and verts (vid, ..) to the vertices in use, numbered by first use as id, and renumbered faces."""
    from lodestone.operators.mesh import face_corners
    from lodestone.operators.scan import dense_number
    from lodestone.session import materialize

    first = face_corners(faces).groupBy("vid").agg(F.min(F.col("tri") * 3 + F.col("corner")).alias("first"))
    ids = materialize(dense_number(first, F.col("first"), name="id").select("vid", "id"), "ids")
    out = faces
    for k in range(3):
        out = out.join(ids.withColumnsRenamed({"vid": f"i{k}", "id": f"n{k}"}), f"i{k}")
    return verts.join(ids, "vid"), out.select("tri", *(F.col(f"n{k}").alias(f"i{k}") for k in range(3)))


def node_payloads(triangles: DataFrame, exponent: int | None = None) -> DataFrame:
    """triangles (id, to, x0..z2) to (id, nvert, nface, dsts, ends, payload): welded, faces in patch order, ends of the patches. With an exponent payloads are compressed at steps of 2^exponent."""
    from lodestone.sources.model_file import compress_payload, pack_payload

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        to = rows.column("to").to_numpy()
        order = np.argsort(to, kind="stable")
        v = np.column_stack([rows.column(c).to_numpy() for c in CORNERS])[order].reshape(-1, 3)
        points, index = np.unique(v.astype("<f4"), axis=0, return_inverse=True)
        if len(points) > 65_535:
            raise ValueError("a node of the file holds at most 65535 vertices")
        dsts, counts = np.unique(to, return_counts=True)
        ends = np.cumsum(counts)
        raw = pack_payload(points, index.reshape(-1, 3)) if exponent is None else compress_payload(points, index.reshape(-1, 3), ends, exponent)
        columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([len(points)], pa.int64()), pa.array([len(to)], pa.int64()), pa.array([dsts.tolist()], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([raw], pa.binary())]
        return pa.Table.from_arrays(columns, names=["id", "nvert", "nface", "dsts", "ends", "payload"])

    return triangles.groupBy("id").applyInArrow(run, "id long, nvert long, nface long, dsts array<long>, ends array<long>, payload binary")


def write_node_files(packed: DataFrame, folder: str) -> DataFrame:
    """One file a node, <folder>/<id>.node, written on the executors; (id, path). A retried task writes the same bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        for batch in batches:
            paths = []
            for node, raw in zip(batch.column("id").to_pylist(), batch.column("payload").to_pylist()):
                paths.append(f"{where}/{node}.node")
                with store.open_output_stream(paths[-1]) as out:
                    out.write(raw)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(paths, pa.string())], names=["id", "path"])

    return packed.select("id", "payload").mapInArrow(run, "id long, path string")


def node_plys(verts: DataFrame, faces: DataFrame) -> DataFrame:
    """(node, ply): the text PLY file of each node, of verts (node, vid, x, y, z), dense from 0, and faces (node, tri, i0, i1, i2)."""
    word = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["line"]), "\n")
    points = verts.groupBy("node").agg(F.count("*").alias("nvert"), joined(F.struct("vid", word("x", "y", "z").alias("line"))).alias("points"))
    rings = faces.groupBy("node").agg(F.count("*").alias("nface"), joined(F.struct("tri", F.concat(F.lit("3 "), word("i0", "i1", "i2")).alias("line"))).alias("rings"))
    head = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("nvert"), F.lit("\nproperty float x\nproperty float y\nproperty float z\nelement face "),
        F.coalesce("nface", F.lit(0)), F.lit("\nproperty list uchar int vertex_indices\nend_header"),
    )
    return points.join(rings, "node", "left").select("node", F.concat(F.concat_ws("\n", head, "points", "rings"), F.lit("\n")).alias("ply"))
