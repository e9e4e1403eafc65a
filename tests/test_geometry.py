"""Hand-computed meshes, invariants and round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.bits import bits_needed, trailing_zeros, unzigzag, zigzag
from lodestone.functions.colours import human_bytes
from lodestone.functions.views import frustum_planes, viewpoint
from lodestone.operators import cache, codec, dag, mesh, partition
from lodestone.operators.graph import components
from lodestone.operators.scan import dense_number, prefix_sum
from lodestone.operators.simplify import cluster, simplify
from lodestone.operators.textures import pack_rectangles, pyramid
from lodestone.plans.builder import BuildOptions, LodModel
from lodestone.plans.fixtures import frame
from lodestone.sinks.mesh_files import unified, write_ply, write_stl
from lodestone.sources import binary_meshes, model_file, text_meshes

SOUP = "tri long, node long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz")
CUBE = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
CUBE_FACES = [t for a, b, c, d in QUADS for t in ((a, b, c), (a, c, d))]


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(i, 0, *(v for k in f for v in CUBE[k])) for i, f in enumerate(CUBE_FACES)]
    return spark.createDataFrame(rows, SOUP)


def test_one_triangle(spark):
    one = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], SOUP)
    assert mesh.edge_error(one).first()["error"] == pytest.approx((4 / 3) ** 0.5)
    faces = spark.createDataFrame([(0, 0, 1, 2)], "tri long, i0 long, i1 long, i2 long")
    assert mesh.signed_boundary(faces).count() == 3
    verts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    assert all((r.nx, r.ny, r.nz) == (0, 0, 1) for r in mesh.vertex_normals(faces, verts).collect())


def test_cube_welds(cube):
    verts, faces = mesh.weld(cube)
    assert verts.count() == 8 and faces.count() == 12
    pairs = mesh.opposite_edges(faces)
    assert pairs.filter("other_tri is null").count() == 0 and pairs.count() == 36
    assert mesh.signed_boundary(faces).count() == 0


def test_tiny_dag(spark):
    nodes = spark.createDataFrame([(0, 0, 4.0, 10, 5), (1, 1, 3.0, 10, 5), (2, 1, 2.0, 10, 5), (3, 2, 1.0, 10, 5)], "node long, lvl int, error double, nvert long, nface long")
    patches = spark.createDataFrame([(0, 0, 1, 0, 2), (1, 0, 2, 2, 5), (2, 1, 3, 0, 5), (3, 2, 3, 0, 5), (4, 3, 4, 0, 5)], "patch long, src long, dst long, tri_begin long, tri_end long")
    assert [r.node for r in dag.roots(nodes, patches).collect()] == [0]
    assert {r.node: r.distance for r in dag.sink_distance(patches).collect()} == {0: 3, 1: 2, 2: 2, 3: 1, 4: 0}
    assert sorted(r.node for r in dag.drop_last_level(nodes, patches).collect()) == [0, 1, 2]
    chosen = nodes.filter("node < 2")
    assert sorted((r.src, r.dst) for r in dag.cut(chosen, patches).collect()) == [(0, 2), (1, 3)]
    assert dag.violations(nodes, patches).count() == 0
    raw = nodes.withColumn("error", F.lit(1.0))
    fixed = {r.node: r.error for r in dag.saturate(raw, patches).collect()}
    assert fixed[3] == 1.0 and fixed[0] == pytest.approx(1.01**2)


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(50)), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k double, v long")
    for down in (False, True):
        total, want = 0, {}
        for i, _, v in sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0])):
            total += v
            want[i] = total
        got = {r.i: r.running for r in prefix_sum(df, "v", F.col("k"), F.col("i"), descending=down).collect()}
        assert got == want
    assert sorted(r.number for r in dense_number(df, F.col("k"), F.col("i")).collect()) == list(range(3000))
    assert prefix_sum(df.limit(0), "v", F.col("k")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_kd_partition(spark, sf):
    points = frame(spark, sf, "terrain_v").select("vid", "x", "y", "z")
    cells = partition.kd_partition(points, 100)
    counts = cells.groupBy("cell").count().collect()
    assert max(r["count"] for r in counts) <= 100 and sum(r["count"] for r in counts) == points.count()
    names = {r["cell"] for r in counts}
    assert not any(c >> k in names for c in names for k in range(1, 40) if c >> k)  # no cell lies in another
    same = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(50)], "vid long, x double, y double, z double")
    assert partition.kd_partition(same, 10).select("cell").distinct().count() == 1


def test_simplify_keeps_border():
    n = 12
    p = np.array([(x, y, 0.05 * np.sin(x) * y) for y in range(n) for x in range(n)], float)
    f = np.array([t for y in range(n - 1) for x in range(n - 1) for a in [y * n + x] for t in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))])
    edge = np.array([x in (0, n - 1) or y in (0, n - 1) for y in range(n) for x in range(n)])
    q, g = simplify(p, f, len(f) // 2, edge)
    assert len(g) <= len(f) * 0.6 and {tuple(v) for v in p[edge]} <= {tuple(v) for v in q}

    def area(q, g):
        (ax, ay), (bx, by) = ((q[g[:, k], :2] - q[g[:, 0], :2]).T for k in (1, 2))
        return ax * by - ay * bx

    assert (area(q, g) > 0).all() and area(q, g).sum() == pytest.approx(area(p, f).sum())


def test_cluster(cube):
    assert cluster(cube, 0.9).count() == 12 and cluster(cube, 5.0).count() == 0


def test_build(spark, sf):
    soup = frame(spark, sf, "terrain_s")
    model = LodModel.build(soup, BuildOptions(node_faces=700, top_faces=300))
    nodes, patches = model.nodes.cache(), model.patches
    sink = dag.sink_of(patches)
    assert sink == nodes.count()
    assert dag.violations(nodes, patches).count() == 0
    assert patches.filter("dst <= src").count() == 0
    leaf = patches.filter(F.col("dst") == sink).agg(F.sum(F.col("tri_end") - F.col("tri_begin"))).first()[0]
    assert leaf == soup.count()  # every triangle is in a leaf once
    faces = {r.node: r.nface for r in nodes.collect()}
    assert {r.src: r.n for r in patches.groupBy("src").agg(F.max("tri_end").alias("n")).collect()} == faces
    assert nodes.select("lvl").distinct().count() >= 2
    some = model.select(triangles=400)
    assert some.agg(F.sum("nface")).first()[0] <= 400
    assert model.cut(model.nodes).filter(F.col("dst") != sink).count() == 0


def test_model_round_trip(spark, sf, tmp_path):
    soup = frame(spark, sf, "terrain_s").filter("node < 3")
    model = LodModel.build(soup, BuildOptions(node_faces=500, top_faces=300))
    path = f"file://{tmp_path}/t.lod"
    model.save(path)
    back = LodModel.open(spark, path)
    key = lambda df: sorted(tuple(r) for r in df.select("src", "dst", (F.col("tri_end") - F.col("tri_begin")).alias("n")).collect())
    assert key(back.patches) == key(model.patches)
    some = back.select(error=back.nodes.agg(F.percentile_approx("error", 0.5)).first()[0])
    cut = back.cut(some).agg(F.sum(F.col("tri_end") - F.col("tri_begin"))).first()[0]
    assert back.save_stl(some, f"file://{tmp_path}/c.stl") == cut == back.cut_triangles(some).count()
    back.save_ply(some, f"file://{tmp_path}/c.ply")
    assert binary_meshes.load_soup(spark, f"file://{tmp_path}/c.ply").count() <= cut
    back.save(f"file://{tmp_path}/part.lod", some)
    part = model_file.ModelFile(f"file://{tmp_path}/part.lod")
    assert part.header.n_nodes == some.count() + 1 and part.patches["node"].max() == some.count()


def test_coders():
    rng = random.Random(3)
    for n in (0, 1, 7, 400):
        s = [min(int(rng.expovariate(0.7)), 12) for _ in range(n)]
        t = codec.Tunstall(s)
        assert t.decode(t.encode(s), n) == s
        if n:
            r = codec.RangeCoder([max(1, s.count(k)) for k in range(13)])
            assert r.decode(r.encode(s), n) == s
        v = [rng.randint(-1000, 1000) for _ in range(n)] + [0, -1, 1]
        assert codec.read_differences(*codec.write_differences(v)) == v
    same = codec.Tunstall([4] * 9)
    assert same.decode(same.encode([4] * 9), 9) == [4] * 9
    with pytest.raises(EOFError):
        codec.BitReader(b"").take(1)


def test_bits(spark):
    rows = spark.range(-300, 300).select("id", unzigzag(zigzag(F.col("id"))).alias("z"), bits_needed(F.col("id")).alias("n"), trailing_zeros(F.col("id")).alias("t")).collect()
    for r in rows:
        assert r.z == r.id
        assert r.n == (0 if r.id == 0 else (r.id if r.id >= 0 else -r.id - 1).bit_length() + 1)
        assert r.t == (0 if r.id == 0 else (r.id & -r.id).bit_length() - 1)
    assert [r[0] for r in spark.createDataFrame([(0,), (1536,), (3 * 1024**2,)], "n long").select(human_bytes(F.col("n"))).collect()] == ["0.0B", "1.5K", "3.0M"]


def test_octahedral_round_trip(spark, sf):
    cloud = frame(spark, sf, "cloud").withColumn("n", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2))
    unit = cloud.select(*((F.col(c) / F.col("n")).alias(c) for c in ("nx", "ny", "nz")))
    u, v = codec.octahedral(F.col("nx"), F.col("ny"), F.col("nz"), 1023)
    x, y, z = codec.from_octahedral(u, v, 1023)
    assert unit.agg(F.min(x * F.col("nx") + y * F.col("ny") + z * F.col("nz"))).first()[0] > 0.9999


def test_frustum():
    view = np.eye(4)
    view[2, 3] = -5
    planes = frustum_planes(np.diag([1.0, 1.0, -1.0, 1.0]), view)
    assert planes.shape == (6, 4) and viewpoint(view).tolist() == [0, 0, 5]
    assert np.allclose(np.linalg.norm(planes[:, :3], axis=1), 1)


def test_rectangles_and_pyramid(spark):
    rng = random.Random(2)
    sizes = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(60)]
    side, places = pack_rectangles(sizes)
    used = np.zeros((side, side), bool)
    for (x, y), (w, h) in zip(places, sizes):
        assert not used[y : y + h, x : x + w].any() and x + w <= side and y + h <= side
        used[y : y + h, x : x + w] = True
    with pytest.raises(ValueError):
        pack_rectangles([(10**6, 1)])
    assert pyramid(spark.createDataFrame([(1, 100, 3)], "tex long, w long, h long")).count() == 4


def test_cache_machine():
    c = cache.Cache(100, pending=2)
    assert c.update({1: (5.0, 60), 2: (4.0, 60), 3: (1.0, 10)}) == [("request", 1)]  # 2 does not fit, what is held is no worse
    c.ready(1)
    assert c.update({1: (1.0, 60), 2: (4.0, 60)}) == [("evict", 1), ("request", 2)]
    c.fail(2)
    assert c.update({2: (4.0, 60)}) == [("request", 2)]
    c.fail(2)
    assert c.update({2: (4.0, 60)}) == []
    c.flush()
    assert c.used() == 0 and c.update({2: (4.0, 60)}) == [("request", 2)]


def test_folds_agree(spark, sf):
    log = frame(spark, sf, "frames").filter("frame < 300").select("camera", "frame", "elapsed_ms")
    a, b = ({(r.camera, r.frame): (round(r.fps, 9), round(r.current_error, 9)) for r in f(log).collect()} for f in (cache.control_frames, cache.control_frames_arrow))
    assert a == b and len(a) == 300


def rows_of(df):
    return sorted(tuple(round(v, 5) for v in r) for r in df.select(*binary_meshes.CORNERS).collect())


def test_files_round_trip(spark, cube, tmp_path):
    want = rows_of(cube)
    stl = f"file://{tmp_path}/a/cube.stl"
    assert write_stl(cube, stl) == 12
    assert rows_of(binary_meshes.load_soup(spark, stl)) == want
    verts, faces = mesh.weld(cube)
    used, out = unified(faces, verts)
    write_ply(used, out, f"file://{tmp_path}/a/cube.ply")
    assert rows_of(binary_meshes.load_soup(spark, f"file://{tmp_path}/a/cube.ply")) == want
    (tmp_path / "b.obj").write_text("mtllib m.mtl\nusemtl red\n" + "".join(f"v {x} {y} {z}\n" for x, y, z in CUBE) + "".join("f " + " ".join(f"{k + 1}/1" for k in q) + "\n" for q in QUADS))
    assert rows_of(binary_meshes.load_soup(spark, f"file://{tmp_path}/b.obj")) == want
    body = "".join("facet normal 0 0 0\nouter loop\n" + "".join("vertex {} {} {}\n".format(*CUBE[k]) for k in f) + "endloop\nendfacet\n" for f in CUBE_FACES)
    (tmp_path / "c.stl").write_text(f"solid c\n{body}endsolid\n")
    assert rows_of(binary_meshes.load_soup(spark, f"file://{tmp_path}/c.stl")) == want
    ts = "".join(f"VRTX {i + 1} {x} {y} {z}\n" for i, (x, y, z) in enumerate(CUBE[:7])) + "PVRTX 8 1 1 1 0.5\nATOM 9 8\n" + "".join("TRGL {} {} {}\n".format(*(9 if k == 7 else k + 1 for k in f)) for f in CUBE_FACES)
    (tmp_path / "d.ts").write_text(ts)
    assert rows_of(binary_meshes.load_soup(spark, f"file://{tmp_path}/d.ts")) == want
    raw = np.zeros((12, 27), "<f4")
    raw[:, :9] = [[v for k in f for v in CUBE[k]] for f in CUBE_FACES]
    (tmp_path / "e.tsp").write_bytes(raw.tobytes())
    assert rows_of(binary_meshes.load_soup(spark, f"file://{tmp_path}/e.tsp")) == want
    with pytest.raises(ValueError):
        binary_meshes.load_soup(spark, "x.xyz")


def test_ascii_ply_points(spark, tmp_path):
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\ncomment TextureFile a\\b.png\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n0 1 2 255 0 7\n3 4 5 1 2 3\n")
    rows = binary_meshes.read_ply_points(spark, f"file://{tmp_path}/p.ply").collect()
    assert [(r.x, r.y, r.z, r.r, r.b, r.nx) for r in rows] == [(0, 1, 2, 255, 7, None), (3, 4, 5, 1, 3, None)]
    assert binary_meshes.parse_ply((tmp_path / "p.ply").read_bytes())[2] == ["a/b.png"]


def test_materials(spark, tmp_path):
    (tmp_path / "m.mtl").write_text("newmtl red\nKd 1.0 0.5 0\nd 0.5\nmap_Kd t\\a.png\nnewmtl plain\n")
    got = {r.material: r for r in text_meshes.read_mtl(text_meshes.lines(spark, f"file://{tmp_path}/m.mtl")).collect()}
    assert (got["red"].r, got["red"].g, got["red"].a, got["red"].texture) == (255, 127, 127, "t/a.png")
    assert got["plain"].r == 255 and got["plain"].texture is None


def test_model_file(spark, tmp_path):
    points, faces = np.array(CUBE), np.array(CUBE_FACES)
    nodes = np.zeros(2, model_file.NODE)
    nodes["nvert"], nodes["nface"], nodes["error"], nodes["first_patch"] = 8, 12, [2, 1], [0, 2]
    patches = np.array([(1, 7, model_file.NO_TEXTURE), (2, 12, model_file.NO_TEXTURE), (2, 12, model_file.NO_TEXTURE)], model_file.PATCH)
    sig = model_file.signature(normals=True)
    head = model_file.Header(2, 16, 24, sig, 3, 3, 0, (0.5, 0.5, 0.5, 1.0))
    payload = lambda: model_file.pack_payload(points, faces, points / 2)
    path = f"file://{tmp_path}/m/model.bin"
    model_file.write(path, head, nodes, patches, iter([payload(), payload()]))
    f = model_file.ModelFile(path)
    assert f.header.n_nodes == 3 and f.roots() == 1 and all(int(n["offset"]) * 256 % 256 == 0 for n in f.nodes)
    assert (f.payload(1)["faces"] == faces).all() and np.allclose(f.payload(0)["normals"], points / 2, atol=1e-4)
    n, p = model_file.tables(spark, path)
    assert [(r.src, r.dst, r.tri_begin, r.tri_end) for r in p.orderBy("patch").collect()] == [(0, 1, 0, 7), (0, 2, 7, 12), (1, 2, 0, 12)]
    assert model_file.read_triangles(spark, path, n.filter("node = 1")).count() == 12
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_bytes(b"0" * 200)
        model_file.ModelFile(f"file://{tmp_path}/bad")
