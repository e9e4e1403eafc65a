"""Text mesh formats (OBJ with MTL, ASCII STL, GOCAD TS, ASCII PLY) by line-oriented DataFrames.

Every reader starts from (path, line, text). Line numbers come from one file per task, so nothing
is sorted across files; state such as the current material is carried forward by windows over ranges of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.scan import ranged, small
from lodestone.session import materialize

NUMBER = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line, text), lines numbered from 0 in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                texts = content.decode("utf-8", "replace").splitlines()
                for at in range(0, len(texts), 65536):
                    part = texts[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], names=["path", "line", "text"])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(run, "path string, line long, text string")


def carry_forward(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """rows plus the last match of pattern's group at or before each line of a file: an as-of join with itself.

    A file may hold all rows, so that a window a file would be one task. Rows are cut into ranges of
    (path, line), and a range begins with the last match that earlier ranges hold of the same file."""
    found = F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1))
    cut = materialize(ranged(rows.withColumn(name, found), F.col("path"), F.col("line")), "lines")
    last = cut.filter(F.col(name).isNotNull()).groupBy("_range", "path").agg(F.max_by(name, "line").alias("_last"))
    parts = cut.select("_range", "path").distinct().join(last, ["_range", "path"], "left")  # a row a range and one a file, about
    before = Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_range", "path", F.last("_last", ignorenulls=True).over(before).alias("_carried")).filter("_carried is not null")
    w = Window.partitionBy("_range", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn(name, F.last(name, ignorenulls=True).over(w)).join(small(carried), ["_range", "path"], "left")
    return own.select(*(c for c in rows.columns if c != name), F.coalesce(name, "_carried").alias(name))


def fan(polygons: DataFrame, ring: str) -> DataFrame:
    """polygons with an array of corners to triangles (0, part, part + 1)."""
    part = F.explode(F.sequence(F.lit(1), F.size(ring) - 2)).alias("part")
    out = polygons.filter(F.size(ring) >= 3).select("*", part)
    return out.select("*", F.get(ring, F.lit(0)).alias("i0"), F.get(ring, F.col("part")).alias("i1"), F.get(ring, F.col("part") + 1).alias("i2"))


def ordinal(rows: DataFrame, name: str) -> DataFrame:
    """rows plus a 0-based number by line within each file."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("path").orderBy("line")).cast("long") - 1)


def _words(text: Column) -> Column:
    return F.split(F.btrim(text), r"\s+")


def read_obj(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, vid, x, y, z) and (path, tri, i0, i1, i2, material): polygons as fans; negative indices are an error."""
    w = F.col("w")
    carried = carry_forward(rows, r"^\s*usemtl\s+(\S+)", "material").withColumn("w", _words(F.col("text")))
    verts = ordinal(carried.filter(w[0] == "v"), "vid").select("path", "vid", *(F.get(w, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")))
    index = lambda s: F.split(s, "/")[0].try_cast("long")
    checked = lambda s: F.when(index(s) < 1, F.raise_error(F.lit("relative indices are not supported")).cast("long")).otherwise(index(s) - 1)
    # the test stands in the ring as well: a filter on it may run before that on the lines
    faces = carried.filter(w[0] == "f").select("path", "line", "material", F.when(w[0] == "f", F.transform(F.slice(w, F.lit(2), F.size(w)), checked)).alias("ring"))
    triangles = fan(faces, "ring").filter("i0 != i1 and i1 != i2 and i0 != i2")
    numbered = triangles.withColumn("tri", F.row_number().over(Window.partitionBy("path").orderBy("line", "part")).cast("long") - 1)
    return verts, numbered.select("path", "tri", "i0", "i1", "i2", "material")


def read_mtl(rows: DataFrame) -> DataFrame:
    """(path, material, r, g, b, a, texture): Kd and d as bytes, map_Kd with forward slashes."""
    carried = carry_forward(rows, r"^\s*newmtl\s+(\S+)", "material").filter("material is not null").withColumn("w", _words(F.col("text")))
    w = F.col("w")
    byte = lambda c: F.floor(c.try_cast("double") * 255).cast("int")
    pick = lambda key, value: F.max(F.when(w[0] == key, value))
    return carried.groupBy("path", "material").agg(
        *(F.coalesce(pick("Kd", byte(F.get(w, F.lit(i + 1)))), F.lit(255)).alias(c) for i, c in enumerate("rgb")),
        F.coalesce(pick("d", byte(F.get(w, F.lit(1)))), F.lit(255)).alias("a"),
        F.replace(pick("map_Kd", F.get(w, F.lit(1))), F.lit("\\"), F.lit("/")).alias("texture"),
    )


def read_stl_text(rows: DataFrame) -> DataFrame:
    """(path, tri, x0..z2) of vertex lines, three a facet."""
    vertex = rf"^\s*vertex\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})"
    found = ordinal(rows.filter(F.col("text").rlike(vertex)), "n")
    each = found.select("path", F.floor(F.col("n") / 3).alias("tri"), (F.col("n") % 3).alias("corner"), *(F.regexp_extract("text", vertex, i + 1).try_cast("double").alias(c) for i, c in enumerate("xyz")))
    return each.groupBy("path", "tri").agg(*(F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "xyz"))


def read_ts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, id, x, y, z) of VRTX, PVRTX and ATOM lines (an ATOM copies another vertex), and (path, i0, i1, i2) of TRGL."""
    split = rows.withColumn("w", _words(F.col("text")))
    w = F.col("w")
    own = split.filter(w[0].isin("VRTX", "PVRTX")).select("path", w[1].try_cast("long").alias("id"), *(F.get(w, F.lit(i + 2)).try_cast("double").alias(c) for i, c in enumerate("xyz")))
    alias = split.filter(w[0].isin("ATOM", "PATOM")).select("path", w[1].try_cast("long").alias("id"), w[2].try_cast("long").alias("ref"))
    copied = alias.join(own.withColumnRenamed("id", "ref"), ["path", "ref"]).select("path", "id", "x", "y", "z")
    faces = split.filter(w[0] == "TRGL").select("path", *(F.get(w, F.lit(i + 1)).try_cast("long").alias(f"i{i}") for i in range(3)))
    return own.union(copied), faces


def georeference_json(*origin: Column) -> Column:
    return F.to_json(F.struct(F.array(*origin).alias("origin")))


def georeference_of(sidecar: Column) -> Column:
    return F.from_json(sidecar, "origin array<double>")["origin"]


def texture_path(path: Column, model: str) -> Column:
    """Forward slashes, relative to the model's folder."""
    folder = model.rpartition("/")[0]
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit(f"{folder}/" if folder else ""), clean))


def read_ts_colours(rows: DataFrame, property: str, palette: str = "viridis") -> DataFrame:
    """(path, id, r, g, b) of PVRTX lines: a property's value by a palette, between the clips that the property's header states.

    A file that does not list the property is an error; so is one without its clips."""
    from lodestone.functions.colours import mapped

    w = F.col("w")
    split = carry_forward(rows, r"^\s*PROPERTY_CLASS_HEADER\s+(\S+)", "owner").withColumn("w", _words(F.col("text")))
    named = split.filter(w[0] == "PROPERTY_CLASSES").groupBy("path").agg(F.min(F.array_position(w, property)).alias("place"))
    clip = lambda word: F.min(F.when((F.col("owner") == property) & (w[0] == word), F.element_at(w, -1).try_cast("double")))
    clips = split.groupBy("path").agg(clip("low_clip").alias("low"), clip("high_clip").alias("high")).join(named, "path", "left")
    wrong = F.coalesce(F.col("place"), F.lit(0)) < 2
    checked = F.when(wrong | F.col("low").isNull() | F.col("high").isNull(), F.raise_error(F.concat(F.lit(f"no property {property} with clips in "), F.col("path"))).cast("double"))
    # the keyword itself is the list's first word; values follow id, x, y, z
    value = F.get(w, F.col("place").cast("int") + 3).try_cast("double")
    share = F.coalesce(checked, (value - F.col("low")) / (F.col("high") - F.col("low")))
    points = split.filter(w[0] == "PVRTX").join(clips, "path").select("path", w[1].try_cast("long").alias("id"), share.alias("share"))
    return points.select("path", "id", mapped(F.col("share"), 0.0, 1.0, palette).alias("c")).select("path", "id", *(F.get("c", F.lit(i)).alias(c) for i, c in enumerate("rgb")))
