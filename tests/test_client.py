"""Cones, matrices, colours, byte streams and sources that queries do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import cache, codec, dag, mesh, partition, rays
from lodestone.operators.scan import dense_number, prefix_sum
from lodestone.session import clear_scratch, materialize
from lodestone.sources import binary_meshes, text_meshes


def test_matrix_inverse(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(20)] + [(99, [1.0] * 16)]
    got = {r.i: r.inverse for r in spark.createDataFrame(rows, "i long, m array<double>").select("i", vectors.matrix_inverse(F.col("m")).alias("inverse")).collect()}
    assert got.pop(99) is None
    for i, m in rows[:-1]:
        assert np.allclose(np.array(got[i]).reshape(4, 4), np.linalg.inv(np.array(m).reshape(4, 4)))


def test_aligned_bytes():
    blocks = [b"", b"a", b"abcd", b"abcdefg", b"x" * 1000]
    out = codec.AlignedBytes()
    for b in blocks:
        out.put(b)
        assert len(out.raw) % 4 == 0
    back = codec.AlignedBytes(bytes(out.raw))
    assert [back.get() for _ in blocks] == blocks
    with pytest.raises(ValueError):
        codec.AlignedBytes(b"\x09\0\0\0abc").get()


def test_prefix_sums_with_one_hot_key(spark):
    """Rows of one first key are cut by the rest of the sort key, so none of them meet in one task."""
    rows = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("hot"), "id", (F.col("id") % 7).alias("v"))
    got = prefix_sum(rows, "v", F.col("hot"), F.col("id"), name="sum").orderBy("hot", "id").collect()
    total = 0
    for r in got:
        total += r.v
        assert r["sum"] == total
    numbered = dense_number(rows, F.col("hot"), F.col("id"))
    assert sorted(r.number for r in numbered.collect()) == list(range(2000))
    assert prefix_sum(rows.limit(0), "v", F.col("hot")).count() == 0


def test_rays_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    n = 400
    centre, size = rng.uniform(-20, 20, (n, 3)), rng.choice([0.05, 0.4, 3.0], n)
    corners = centre[:, None, :] + rng.normal(size=(n, 3, 3)) * size[:, None, None]
    soup = spark.createDataFrame([(i, *map(float, c.reshape(9))) for i, c in enumerate(corners)], "tri long, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    start = rng.uniform(-30, 30, (60, 3))
    way = centre[:60] - start + rng.normal(size=(60, 3)) * 0.1
    way[:3] = [[0, 0, 1], [0, -1, 0], [1, 0, 0]]
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    asked = spark.createDataFrame([(i, *map(float, o), *map(float, d)) for i, (o, d) in enumerate(zip(start, way))], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    spheres = spark.createDataFrame([(i, *map(float, c), float(s)) for i, (c, s) in enumerate(zip(centre, size))], "node long, cx double, cy double, cz double, radius double")
    distance = vectors.ray_triangle(vectors.vec("ox", "oy", "oz"), vectors.vec("dx", "dy", "dz"), *(vectors.corner(i) for i in range(3)))
    for got, rows, plain in (
        (rays.nearest_triangles(asked, soup), soup, distance),
        (rays.nearest_spheres(asked, spheres), spheres, vectors.ray_sphere(vectors.vec("ox", "oy", "oz"), vectors.vec("dx", "dy", "dz"), vectors.vec("cx", "cy", "cz"), F.col("radius"))),
    ):
        want = {r.ray: r.d for r in asked.crossJoin(rows).withColumn("d", plain).filter("d is not null").groupBy("ray").agg(F.min("d").alias("d")).collect()}
        assert {r.ray: r.distance for r in got.collect()} == pytest.approx(want) and want
    far = rays.nearest_triangles(asked, soup, 25.0, 60.0)
    assert all(25 <= r.distance <= 60 for r in far.collect())
    assert rays.nearest_triangles(asked, soup.limit(0)).count() == 0


def test_no_nested_loop_for_rays(spark):
    soup = spark.range(100).selectExpr("id as tri", *(f"cast(id + {k} as double) as {a}{k}" for k in range(3) for a in "xyz"))
    asked = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    found = rays._cells(soup, {c: (F.col(f"{c}0"), F.col(f"{c}2")) for c in "xyz"}, 4.0)
    assert found.groupBy("tri").count().agg(F.max("count")).first()[0] <= 27
    assert rays.nearest_triangles(asked, soup).count() <= 1


def test_partition_ends_or_raises(spark):
    points = spark.range(500).selectExpr("id as vid", "cast(id as double) as x", "0.0D as y", "0.0D as z")
    cells = partition.kd_partition(points, 40)
    assert cells.columns == ["vid", "x", "y", "z", "cell"] and cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 40
    same = points.withColumn("x", F.lit(1.0))
    assert partition.kd_partition(same, 40).select("cell").distinct().count() == 1  # nothing to split by
    with pytest.raises(RuntimeError):
        partition.kd_partition(points, 2, max_levels=2)


def test_client_cut_visits_until_blocked(spark):
    nodes = spark.createDataFrame([(0, 9.0, 10, True, True), (1, 5.0, 10, True, True), (2, 4.0, 10, False, True), (3, 3.0, 10, True, True), (4, 1.0, 10, True, True)], "node long, error double, nvert long, ready boolean, visible boolean")
    patches = spark.createDataFrame([(0, 0, 1, 0, 1), (1, 0, 2, 1, 2), (2, 1, 3, 0, 1), (3, 2, 4, 0, 1), (4, 3, 5, 0, 1), (5, 4, 5, 0, 1)], "patch long, src long, dst long, tri_begin long, tri_end long")
    got = {r.node: (r.selected, r.requested) for r in dag.client_cut(nodes, patches, 2.0, 1000.0).collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (False, True), 3: (True, False), 4: (False, False)}
    got = {r.node: r.selected for r in dag.client_cut(nodes, patches, 2.0, 7.0, blocked_limit=2).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_renderer_rate_is_a_fold(spark):
    frames = spark.createDataFrame([(c, i, float((i * 7 + c) % 50)) for c in range(2) for i in range(600)], "camera long, frame long, elapsed_ms double")
    got = {(r.camera, r.frame): r.fps for r in cache.renderer_rate(frames).collect()}
    for c in range(2):
        fps = 0.0
        for i in range(600):
            e = float((i * 7 + c) % 50)
            fps = 0.1 * (1000 / e) + 0.9 * fps if e > 0 else fps
            assert got[c, i] == pytest.approx(fps)


TS = """GOCAD TSurf 1
PROPERTY_CLASSES depth age
PROPERTY_CLASS_HEADER depth {
low_clip 0
high_clip 10
}
PROPERTY_CLASS_HEADER age {
low_clip 100
high_clip 300
}
TFACE
PVRTX 1 0 0 0 5 100
PVRTX 2 1 0 0 10 200
PVRTX 3 0 1 0 0 999
TRGL 1 2 3
"""


def test_folders_clouds_and_property_colours(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.ts").write_text(TS)
    (tmp_path / "m" / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n0 0 0\n")
    (tmp_path / "m" / "notes.txt").write_text("no mesh")
    names = [p.rpartition("/")[2] for p in binary_meshes.expanded(spark, str(tmp_path / "m"))]
    assert names == ["a.ts", "b.ply"]
    assert binary_meshes.is_cloud(spark, str(tmp_path / "m")) and not binary_meshes.is_cloud(spark, str(tmp_path / "m" / "a.ts"))
    assert binary_meshes.load_soup(spark, str(tmp_path / "m" / "a.ts")).count() == 1
    rows = text_meshes.lines(spark, str(tmp_path / "m" / "a.ts"))
    got = {r.id: (r.r, r.g, r.b) for r in text_meshes.read_ts_colours(rows, "age", "plasma").collect()}
    assert got[1] == (12, 7, 134) and got[3] == (239, 248, 81)  # the map's ends: values are clamped
    with pytest.raises(Exception, match="no property"):
        text_meshes.read_ts_colours(rows, "weight").collect()
    points = binary_meshes.read_ply_points(spark, str(tmp_path / "m" / "b.ply"))
    assert "nx" not in binary_meshes.with_components(points, normals=False, colors=True).columns
    with pytest.raises(ValueError):
        binary_meshes.with_components(points, textures=True)


def test_seams_number_every_wedge(spark):
    rows = [(0, 1, 0.5, 0.5), (0, 1, 0.5, 0.5), (0, 1, 0.25, 0.5), (1, None, 0.5, 0.5), (1, None, 0.5, 0.5)]
    wedges = spark.createDataFrame(rows, "vid long, tex long, u double, v double")
    assert sorted(r.svid for r in mesh.split_seams(wedges).collect()) == [0, 1, 1, 2, 2]


def test_scratch_can_be_cleared(spark):
    kept = materialize(spark.range(3), "x")
    assert kept.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception):
        kept.collect()


def test_compressed_model_round_trip(spark, sf, tmp_path):
    from lodestone.plans.builder import BuildOptions, LodModel
    from lodestone.plans.fixtures import frame
    from lodestone.sources import model_file

    soup = frame(spark, sf, "terrain_s").filter("node < 3")
    model = LodModel.build(soup, BuildOptions(node_faces=500, top_faces=300))
    raw, small = f"file://{tmp_path}/a.lod", f"file://{tmp_path}/b.lod"
    model.save(raw)
    model.save(small, quality=0.05)
    a, b = model_file.ModelFile(raw), model_file.ModelFile(small)
    assert model_file.is_compressed(b.header.signature) and not model_file.is_compressed(a.header.signature)
    assert (a.patches == b.patches).all() and (a.nodes["nface"] == b.nodes["nface"]).all()
    assert int(b.nodes["offset"][-1]) < int(a.nodes["offset"][-1])
    for node in range(len(a.nodes) - 1):
        p, q = a.payload(node), b.payload(node)
        ends = np.append(0, a.patches["triangle_offset"][a.nodes["first_patch"][node] : a.nodes["first_patch"][node + 1]].astype(int))
        for begin, end in zip(ends, ends[1:]):  # each patch has its faces, up to the step
            x, y = (np.sort(np.round(m["points"][m["faces"][begin:end].astype(int)].mean(1), 1), axis=0) for m in (p, q))
            assert len(x) == len(y) and np.allclose(x, y, atol=0.2)
    back = LodModel.open(spark, small)
    assert back.triangles.count() == model.triangles.count()


def test_cloud_model(spark):
    from lodestone.plans.builder import BuildOptions, build_cloud

    rng = np.random.default_rng(2)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 10, (3000, 3)))]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    nodes, patches, own = build_cloud(points, BuildOptions(node_faces=400, top_faces=150))
    assert sorted(r.pid for r in own.collect()) == list(range(3000))
    sizes = {r.node: r.nvert for r in nodes.collect()}
    assert sorted(sizes) == list(range(len(sizes))) and sum(sizes.values()) == 3000 and max(sizes.values()) <= 400
    sink = patches.agg(F.max("dst")).first()[0]
    assert sink == len(sizes) and dag.violations(nodes, patches).count() == 0
    assert all(r.src < r.dst for r in patches.collect()) and nodes.select("lvl").distinct().count() >= 3
    assert {r.src: r.n for r in patches.groupBy("src").agg(F.max("tri_end").alias("n")).collect()} == sizes
    empty = build_cloud(points.limit(0))
    assert empty[0].count() == empty[2].count() == 0


def test_coders_are_linear_and_exact():
    import random

    rng = random.Random(8)
    for n, k in ((0, 2), (1, 2), (5000, 3), (5000, 200)):
        symbols = [min(int(rng.expovariate(0.3)), k - 1) for _ in range(n)]
        for frequencies in ([max(1, symbols.count(j)) for j in range(k)], [1 << rng.randint(0, 30) for _ in range(k)]):
            coder = codec.RangeCoder(frequencies)
            assert coder.decode(coder.encode(symbols), n) == symbols
    values = [(rng.randrange(1 << b) if b else 0, b) for b in (rng.randint(0, 70) for _ in range(3000))]
    out = codec.BitWriter()
    for v, b in values:
        out.put(v, b)
    back = codec.BitReader(out.bytes())
    assert [back.take(b) for _, b in values] == [v for v, _ in values]
    with pytest.raises(EOFError):
        back.take(64)


def test_command_line(spark, tmp_path, capsys):
    from lodestone.__main__ import main

    n = 12
    verts = "".join(f"v {i % n} {i // n} {(i * 7) % 5}\n" for i in range(n * n))
    faces = "".join(f"f {a} {a + 1} {a + n}\nf {a + 1} {a + n + 1} {a + n}\n" for y in range(n - 1) for x in range(n - 1) for a in [y * n + x + 1])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.obj").write_text(verts + faces)
    model = f"file://{tmp_path}/m.lod"
    main(["build", f"file://{tmp_path}/in", "-o", model, "-f", "80", "-t", "40", "-z", "0.01"], spark)
    main(["info", model, "--nodes", "--dag", "--patches"], spark)
    said = capsys.readouterr().out
    assert "n_nodes" in said and "children" in said and "offset" in said
    main(["edit", model, "-o", f"file://{tmp_path}/all.stl"], spark)
    assert binary_meshes.read_stl_binary(spark, f"file://{tmp_path}/all.stl").count() == 2 * (n - 1) ** 2
    main(["edit", model, "-o", f"file://{tmp_path}/part.ply", "-d"], spark)
    assert 0 < binary_meshes.load_soup(spark, f"file://{tmp_path}/part.ply").count() < 2 * (n - 1) ** 2
    with pytest.raises(SystemExit):
        main(["edit", model], spark)
