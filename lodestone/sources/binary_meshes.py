"""Binary mesh formats (STL, TSP, PLY) by numpy over whole files, and loading by suffix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import text_meshes

CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]
SOUP = "path string, tri long, " + ", ".join(f"{c} double" for c in CORNERS)
#: Triangles handed on at once.
ROWS = 65_536
STL_RECORD = np.dtype([("normal", "<f4", 3), ("v", "<f4", 9), ("attribute", "<u2")])
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _files(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def _soup(path: str, corners: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(corners), ROWS):
        part = corners[at : at + ROWS].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), *(pa.array(part[:, k].copy()) for k in range(9))], names=["path", "tri", *CORNERS])


def _each(parse):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield from parse(path, content)

    return run


def parse_stl(content: bytes) -> np.ndarray:
    n = int.from_bytes(content[80:84], "little")
    if len(content) < 84 + n * STL_RECORD.itemsize:
        raise ValueError("the file is shorter than its count says")
    return np.frombuffer(content, STL_RECORD, n, 84)["v"]


def parse_tsp(content: bytes) -> np.ndarray:
    return np.frombuffer(content, "<f4", len(content) // 108 * 27).reshape(-1, 27)


def read_stl_binary(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, tri, x0..z2)."""
    return _files(spark, paths).mapInArrow(_each(lambda path, raw: _soup(path, parse_stl(raw))), SOUP)


def read_tsp(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, tri, x0..z2) of position, normal, colour records."""
    return _files(spark, paths).mapInArrow(_each(lambda path, raw: _soup(path, parse_tsp(raw)[:, :9])), SOUP)


def parse_ply(content: bytes) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[str]]:
    """Vertex columns by name, faces as corner arrays, texture file names of the comments."""
    end = content.index(b"end_header") + len(b"end_header")
    end = content.index(b"\n", end) + 1
    form, elements, textures = "ascii", [], []
    for line in content[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[2:4] if w[1] == "list" else w[1]))
        elif w[:2] in (["comment", "TextureFile"], ["comment", "TEXTUREFILE"]):
            textures.append(line.split(None, 2)[2].replace("\\", "/"))
    order = ">" if form == "binary_big_endian" else "<"
    words = iter(content[end:].split()) if form == "ascii" else None
    at, columns, faces = end, {}, []

    def one(kind: str, n: int) -> np.ndarray:
        nonlocal at
        if words is not None:
            return np.array([float(next(words)) for _ in range(n)])
        dtype = np.dtype(order + PLY_TYPES[kind])
        out = np.frombuffer(content, dtype, n, at)
        at += n * dtype.itemsize
        return out

    for name, n, properties in elements:
        if not any(isinstance(k, list) for _, k in properties):
            if words is not None:
                table = np.array([float(next(words)) for _ in range(n * len(properties))]).reshape(n, -1)
                found = {p: table[:, i] for i, (p, _) in enumerate(properties)}
            else:
                record = np.dtype([(p, order + PLY_TYPES[k]) for p, k in properties])
                table = np.frombuffer(content, record, n, at)
                at += n * record.itemsize
                found = {p: table[p] for p, _ in properties}
            if name == "vertex":
                columns = found
            continue
        for _ in range(n):
            for p, k in properties:
                values = one(k[1], int(one(k[0], 1)[0])) if isinstance(k, list) else one(k, 1)
                if name == "face" and p in ("vertex_indices", "vertex_index"):
                    faces.append(values.astype(np.int64))
    return columns, faces, textures


def read_ply_soup(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, tri, x0..z2): polygons as fans, degenerate triangles dropped, a bad index is an error."""

    def parse(path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        columns, faces, _ = parse_ply(raw)
        p = np.column_stack([columns[c] for c in "xyz"]).astype(np.float64)
        index = np.array([(f[0], f[j], f[j + 1]) for f in faces for j in range(1, len(f) - 1)], np.int64).reshape(-1, 3)
        if len(index) and (index.min() < 0 or index.max() >= len(p)):
            raise ValueError(f"Bad index in {path}")
        c = p[index]
        same = (c[:, [0, 1, 0]] == c[:, [1, 2, 2]]).all(2).any(1)
        yield from _soup(path, c[~same].reshape(-1, 9))

    return _files(spark, paths).mapInArrow(_each(parse), SOUP)


def read_ply_points(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, pid, x, y, z, nx, ny, nz, r, g, b) of vertex-only files; absent columns are null."""
    names = ["x", "y", "z", "nx", "ny", "nz"]

    def parse(path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        columns, _, _ = parse_ply(raw)
        n = len(columns["x"])
        colour = [columns.get(c, columns.get(f"diffuse_{c}")) for c in ("red", "green", "blue")]
        none = lambda kind: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(n)), *(pa.array(columns[c].astype(np.float64)) if c in columns else none(pa.float64()) for c in names), *(none(pa.int32()) if v is None else pa.array(v.astype(np.int32)) for v in colour)], names=["path", "pid", *names, "r", "g", "b"])

    return _files(spark, paths).mapInArrow(_each(parse), "path string, pid long, " + ", ".join(f"{c} double" for c in names) + ", r int, g int, b int")


#: Suffixes of the formats that load_soup reads.
SUFFIXES = ("obj", "ply", "stl", "ts", "tsp")


def expanded(spark: SparkSession, *paths: str) -> list[str]:
    """The paths, a folder replaced by the mesh files in it, in the order of their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(conf)
        if store.exists(where) and store.getFileStatus(where).isDirectory():
            files = sorted(str(f.getPath().toString()) for f in store.listStatus(where) if f.isFile())
            out += [f for f in files if f.rpartition(".")[2].lower() in SUFFIXES]
        else:
            out.append(path)
    return out


def is_cloud(spark: SparkSession, *paths: str) -> bool:
    """Whether the input is a point cloud: the first .ply among the files has no faces."""
    first = next((p for p in expanded(spark, *paths) if p.lower().endswith(".ply")), None)
    if first is None:
        return False
    head = spark.read.format("binaryFile").load(first).select(F.substring("content", 1, 1 << 16).cast("string").alias("head"))
    faces = F.regexp_extract("head", r"element\s+face\s+([0-9]+)", 1)
    return head.select((F.coalesce(faces.try_cast("long"), F.lit(0)) == 0).alias("cloud")).first()["cloud"]


#: Columns of each component that an input may have.
COMPONENTS = {"normals": ("nx", "ny", "nz"), "colors": ("r", "g", "b"), "textures": ("u", "v", "tex")}


def with_components(rows: DataFrame, **keep: bool) -> DataFrame:
    """rows without the columns of components that are switched off (normals=False); one that is switched on must be there."""
    for name, wanted in keep.items():
        columns = COMPONENTS[name]
        if wanted and not set(columns) <= set(rows.columns):
            raise ValueError(f"the input has no {name}")
        if not wanted:
            rows = rows.drop(*columns)
    return rows


def load_soup(spark: SparkSession, *paths: str) -> DataFrame:
    """Triangles of files of any known format, by suffix, as one table (path, tri, x0..z2); of a folder, all its mesh files."""
    from lodestone.operators.mesh import to_soup

    paths = expanded(spark, *paths)
    by: dict[str, list[str]] = {}
    for path in paths:
        by.setdefault(path.rpartition(".")[2].lower(), []).append(path)
    out = None
    for suffix, own in sorted(by.items()):
        if suffix == "ply":
            soup = read_ply_soup(spark, *own)
        elif suffix == "tsp":
            soup = read_tsp(spark, *own)
        elif suffix == "stl":
            head = {r["path"] for r in spark.read.format("binaryFile").load(own).filter(F.substring("content", 1, 5) == F.lit(b"solid")).select("path").collect()}  # a row a file
            text = [p for p in own if any(h.endswith(p.removeprefix("file:").lstrip("/")) for h in head)]
            rest = [p for p in own if p not in text]
            parts = ([text_meshes.read_stl_text(text_meshes.lines(spark, *text))] if text else []) + ([read_stl_binary(spark, *rest)] if rest else [])
            soup = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        elif suffix in ("obj", "ts"):
            soup = None
            for path in own:  # vertex ids are those of one file
                rows = text_meshes.lines(spark, path)
                if suffix == "obj":
                    verts, faces = text_meshes.read_obj(rows)
                else:
                    verts, faces = text_meshes.read_ts(rows)
                    verts, faces = verts.withColumnRenamed("id", "vid"), faces.withColumn("tri", F.monotonically_increasing_id())
                one = to_soup(faces.drop("path"), verts.drop("path")).select(F.lit(path).alias("path"), "tri", *CORNERS)
                soup = one if soup is None else soup.unionByName(one)
        else:
            raise ValueError(f"no reader for .{suffix} files")
        out = soup if out is None else out.unionByName(soup)
    return out.select("path", "tri", *CORNERS)
