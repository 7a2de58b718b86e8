"""Small facts and brute-force checks of operators that SQL doesn't cover."""

import math

import numpy as np

from gridloom.functions import geometry as G
from gridloom.functions import sfc
from gridloom.operators import connectivity, exchange, ids, isosurface, partition, reduce, spatial
from gridloom.plans.queries import with_corners
from gridloom.sources import generators
from pyspark.sql import functions as F


def test_ids(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((8, 1, 12, 8, 4))], "i int, v long")
    assert [r.gnum for r in ids.from_keys(df, ["v"]).orderBy("i").collect()] == [3, 1, 4, 3, 2]
    pairs = spark.createDataFrame([(0, 8, 0), (1, 1, 1), (2, 12, 0), (3, 8, -4), (4, 4, 0)], "i int, a long, b long")
    assert [r.gnum for r in ids.from_tuples(pairs, ["a", "b"]).orderBy("i").collect()] == [3, 1, 5, 4, 2]
    pts = [(0, 0.0, 0.0, 0.0), (1, 0.5, 0.5, 0.0), (2, -1.0, 0.0, 0.0), (3, 1.0, 1.0, 1.0), (4, 0.8, -1.0, 0.5), (5, 1.0, 1.0, 1.0)]
    got = [r.gnum for r in ids.from_coordinates(spark.createDataFrame(pts, "i int, x double, y double, z double"), merge=True).orderBy("i").collect()]
    assert got == [3, 4, 1, 5, 2, 5]
    assert [(r.lo, r.hi) for r in ids.uniform_distribution(spark, 9, 2).collect()] == [(0, 5), (5, 9)]
    counts = spark.createDataFrame([(0, 10), (1, 5)], "rank int, n long")
    assert [(r.lo, r.hi) for r in ids.counted_distribution(counts, 1).orderBy("rank").collect()] == [(1, 11), (11, 16)]


def test_merge_and_reverse(spark):
    gnum, size, at = (2, 2, 5, 5, 1, 2, 1), (0, 4, 2, 2, 1, 3, 2), 1
    rows = []
    for k, (g, n) in enumerate(zip(gnum, size, strict=True)):
        rows.append((0, 0, k, g, list(range(at, at + n))))
        at += n
    df = spark.createDataFrame(rows, "rank int, part int, lnum int, gnum long, v array<int>")
    m = exchange.to_block(df, ["v"], "arrays").select("gnum", F.flatten("v").alias("v")).orderBy("gnum").collect()
    assert [(r.gnum, r.v) for r in m] == [(1, [9, 13, 14]), (2, [1, 2, 3, 4, 10, 11, 12]), (5, [5, 6, 7, 8])]
    flat = exchange.to_block(df, ["v"], "merge").orderBy("gnum", "pos").collect()
    assert [(r.gnum, r.pos, r.v) for r in flat] == [(1, 0, [9]), (1, 1, [13, 14]), (2, 0, []), (2, 1, [1, 2, 3, 4]), (2, 2, [10, 11, 12]), (5, 0, [5, 6]), (5, 1, [7, 8])]
    back = exchange.reverse(df, ["v"]).select("lnum", F.size(F.flatten("v")).alias("n")).orderBy("lnum").collect()
    assert [r.n for r in back] == [7, 7, 4, 4, 3, 7, 3]


def test_ids_of_shared_entities(spark):
    places = [(0, 0, k) for k in range(1, 10)] + [(1, 0, k) for k in range(1, 13)]
    pairs = [((0, 0, a), (1, 0, b)) for a, b in ((3, 1), (6, 5), (9, 9))]
    cols = "rank int, part int, lnum int"
    graph = spark.createDataFrame([a + b for a, b in pairs] + [b + a for a, b in pairs], cols + ", o_rank int, o_part int, o_lnum int")
    got = ids.from_shared(spark.createDataFrame(places, cols), graph).orderBy("rank", "lnum").collect()
    assert [r.gnum for r in got] == [1, 2, 7, 3, 4, 8, 5, 6, 9, 7, 10, 11, 12, 8, 13, 14, 15, 9, 16, 17, 18]


def test_permutations(spark):
    perm = spark.createDataFrame(list(zip(range(1, 6), (5, 3, 2, 1, 4), strict=True)), "gnum long, image long")
    assert [r.image for r in ids.invert(perm).orderBy("gnum").collect()] == [4, 3, 2, 5, 1]
    df = spark.createDataFrame([(k, f"v{k}") for k in range(1, 6)], "gnum long, v string")
    assert [r.v for r in ids.permute(df, perm).orderBy("gnum").collect()] == ["v4", "v3", "v2", "v5", "v1"]


def test_blocks(spark):
    block = spark.createDataFrame(list(zip(range(1, 8), (5, 8, 11, 0, 3, 1, 9), strict=True)), "gnum long, v int")
    to = spark.createDataFrame([(0, 0, 4), (1, 4, 7)], "rank int, lo long, hi long")
    got = exchange.to_other_block(block, to).orderBy("rank", "pos").collect()
    assert [[r.v for r in got if r.rank == k] for k in (0, 1)] == [[5, 8, 11, 0], [3, 1, 9]]
    six = spark.createDataFrame(list(zip(range(1, 7), (5, 4, 6, 1, 3, 2), strict=True)), "gnum long, v int")
    asked = spark.createDataFrame([(k, g) for k, g in enumerate((1, 2, 4, 3, 5, 6))], "k int, gnum long")
    assert [r.v for r in exchange.to_parts(asked, six).orderBy("k").collect()] == [5, 4, 1, 6, 3, 2]
    both = exchange.multi_block([six, block], [6, 0])
    assert {(r.gnum, r.v) for r in both.collect()} >= {(1, 5), (6, 2), (7, 5), (13, 9)}


def test_neighbours_and_bridges(spark):
    values = spark.createDataFrame([(0, p, k, 10 * p + k) for p in (0, 1) for k in range(4)], "rank int, part int, lnum int, v int")
    graph = spark.createDataFrame([(0, 0, 0, 0, 0, 1, 0), (0, 0, 1, 0, 0, 1, 2), (0, 1, 0, 0, 0, 0, 1), (0, 1, 2, 0, 0, 0, 2)], "rank int, part int, lnum int, pos int, o_rank int, o_part int, o_lnum int")
    got = {(r.part, r.lnum): r.v for r in exchange.neighbours(values, graph).collect()}
    assert got == {(0, 0): 10, (0, 1): 12, (1, 0): 1, (1, 2): 2}
    bridge = spark.createDataFrame([(4, 0, 0, 1), (2, 0, 0, 1), (2, 0, 1, 5)], "gnum1 long, o_rank int, o_part int, o_lnum int")
    v = spark.createDataFrame([(2, "b"), (4, "d")], "gnum long, v string")
    assert [tuple(r) for r in exchange.across_triplets(bridge, v).orderBy("part", "lnum", "pos").collect()] == [(0, 0, 1, 1, 2, "b"), (0, 0, 1, 2, 4, "d"), (0, 1, 5, 1, 2, "b")]


def test_groups_keep_their_kind(spark):
    g = spark.createDataFrame([("face", 1, 7), ("face", 1, 7), ("edge", 1, 7), ("face", 2, 7)], "kind string, group int, gnum long")
    assert {(r.kind, r.group, r.pos) for r in connectivity.group_transpose(g).collect()} == {("edge", 1, 1), ("face", 1, 2), ("face", 2, 3)}


def test_one_rule_on_the_level(spark):
    v = spark.createDataFrame([(k + 1, *p, x) for k, (p, x) in enumerate(zip(((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (0.0, 1.0, -1.0, -1.0), strict=True))], "gnum long, x double, y double, z double, value double")
    t = spark.createDataFrame([(1, "tetra", [1, 2, 3, 4])], "gnum long, elt_type string, vtx array<long>")
    edges = isosurface.triangles(t, v).select(F.explode("edges").alias("e")).select("e.v1", "e.v2")
    assert edges.count() == isosurface.crossings(edges, v).count() == 3
    assert [r.gnum for r in isosurface.on_level(v).collect()] == [1]


def test_mixed_elements(spark):
    """Sections, orientation, cuts and children of all volume types."""
    from gridloom.operators import elements

    v, e = generators.cube_vertices(spark, 5), generators.cube_mixed(spark, 5)
    mirrored = e.withColumn("vtx", F.when(F.col("gnum") % 2 == 0, elements.by_type({k: elements.picked("vtx", m) for k, m in elements.MIRRORS.items() if k in elements.SPLITS})).otherwise(F.col("vtx")))
    assert elements.measures(mirrored, v).where("volume < 0").count() == e.where("gnum % 2 = 0").count()
    assert {(r.gnum, tuple(r.vtx)) for r in elements.reorient(mirrored, v).collect()} == {(r.gnum, tuple(r.vtx)) for r in e.collect()}
    faces, signed = connectivity.descend(e)
    kids = connectivity.children_of(faces.select(F.col("face").alias("gnum"), "vtx"), faces.limit(9).select((-F.col("face")).alias("gnum"), F.reverse("vtx").alias("vtx")))
    assert {(r.child, r.parent, r.way) for r in kids.collect()} == {(-r.face, r.face, -1) for r in faces.limit(9).collect()}
    used, ring = connectivity.repaired(v.unionByName(v.limit(2).withColumn("gnum", F.col("gnum") + 1000)), faces.select(F.col("face").alias("src"), F.posexplode("vtx").alias("pos", "dst")))
    assert used.count() == 125 and ring.agg(F.max("dst")).first()[0] == 125
    cut = isosurface.cut_elements(generators.cube_cells(spark, 5), v.withColumn("value", isosurface.field("plane", 1, 1, 1, 1.3)))
    assert cut.where("parent IS NULL").count() == 0 and cut.select("parent").distinct().count() > 10


def test_partition_conserves(spark):
    from gridloom.plans.queries import cube_parts

    split, cell_face, face_vtx, groups = cube_parts(spark)
    m = partition.partition_mesh(split, cell_face, face_vtx, groups, "random")
    assert m["cells"].count() == 216 and m["cell_face"].count() == 6 * 216 and m["groups"].groupBy("kind", "group").count().select("count").distinct().collect()[0][0] == 36
    assert all(r.n == r.m for n in ("cells", "faces", "vertices") for r in m[n].groupBy("part").agg(F.count("*").alias("n"), F.max("lnum").alias("m")).collect())
    assert m["face_vtx"].groupBy("part", "src").count().where("count <> 4").count() == 0
    inner = m["face_cell"].where("c1 > 0 AND c2 > 0").count()
    cut = m["face_graph"].select("gnum").distinct().count()
    assert inner + cut == 3 * 7 * 36 - 216


def test_cuthill_of_pieces(spark):
    """Against the queue of the textbook, on a graph of several pieces and two parts."""
    import random

    rng = random.Random(3)
    nodes = [(p, 100 * p + k) for p in (0, 1) for k in range(30)]
    edges = [(p, 100 * p + rng.randrange(30), 100 * p + rng.randrange(30)) for p in (0, 1) for _ in range(28)]
    got = {(r.part, r.gnum): r.lnum for r in partition.renumber_cuthill(spark.createDataFrame(nodes, "part int, gnum long"), spark.createDataFrame(edges, "part int, src long, dst long")).collect()}
    for p in (0, 1):
        near = {g: set() for q, g in nodes if q == p}
        for q, a, b in edges:
            if q == p and a != b:
                near[a].add(b)
                near[b].add(a)
        key, seen, out = lambda g: (len(near[g]), g), set(), []
        for start in sorted(near, key=key):
            if start not in seen:
                seen.add(start)
                queue = [start]
                for g in queue:
                    fresh = sorted(near[g] - seen, key=key)
                    seen.update(fresh)
                    queue += fresh
                out += queue
        assert {g: len(out) - k for k, g in enumerate(out)} == {g: got[p, g] for g in near}


def test_boxes_of_many_sizes(spark):
    """Sizes over eight levels an axis, long and flat boxes, points as boxes; against all pairs."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        at, size = rng.uniform(0, 20, 3), 4.0 ** rng.integers(-5, 4, 3) * rng.uniform(0, 1, 3) * (rng.random(3) < 0.9)
        rows.append((k, *map(float, at), *map(float, at + size)))
    b = spark.createDataFrame(rows, "gnum long, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double")
    got = {(r.a_gnum, r.b_gnum) for r in spatial.boxes_meet_within(b).collect()}
    want = {(i, j) for i, *p in rows for j, *q in rows if i < j and all(p[a] <= q[3 + a] and q[a] <= p[3 + a] for a in range(3))}
    assert got == want and len(want) > 50
    pts = b.select("gnum", *[F.col(f"{a}min").alias(a) for a in "xyz"])
    inside = {(r.b_gnum, r.gnum) for r in spatial.points_in_boxes(pts, b).collect()}
    assert inside == {(i, j) for i, *p in rows for j, *q in rows if all(p[a] <= q[a] <= p[3 + a] for a in range(3))}


def test_dense_cluster(spark, monkeypatch):
    """Cells shrink until none is crowded."""
    monkeypatch.setattr(spatial, "CROWD", 20)
    rng = np.random.default_rng(5)
    p = np.r_[rng.uniform(0, 100, (60, 3)), 50 + rng.normal(0, 0.01, (300, 3))]
    c = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "gnum long, x double, y double, z double")
    got = {(r.gnum, r.pos): r.src for r in spatial.nearest(c, c, 3).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    for k in range(len(p)):
        assert [got[k, i] for i in (1, 2, 3)] == np.lexsort((np.arange(len(p)), d[k]))[:3].tolist()


def test_dual_graph(spark):
    arcs = [(1, 2), (2, 5), (5, 4), (4, 3), (4, 2), (3, 1)]
    conn = spark.createDataFrame([(n, k + 1, k + 1) for k, a in enumerate(arcs) for n in a], "src long, pos int, dst long")
    got = {}
    for r in connectivity.dual(conn).collect():
        got.setdefault(r.src, []).append(r.dst)
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 3], 2: [1, 4, 5], 3: [1, 4], 4: [2, 3, 5], 5: [2, 4]}


def test_faces_and_volumes(spark):
    n = 5
    faces, signed = connectivity.descend(generators.cube_cells(spark, n))
    assert faces.count() == 3 * n * (n - 1) ** 2
    assert signed.groupBy(F.abs("dst")).count().where("count = 1").count() == 6 * (n - 1) ** 2
    assert generators.cube_faces(spark, n).where("group > 0").groupBy("group").count().count() == 6
    t = with_corners(generators.cube_tetras(spark, n), generators.cube_vertices(spark, n))
    v = t.select(G.tetra_volume(*[F.col(c) for c in "abcd"]).alias("v")).agg(F.sum("v"), F.min("v")).first()
    assert abs(v[0] - 1) < 1e-12 and v[1] > 0


def test_sphere_is_closed(spark):
    v, t = generators.sphere(spark, 12, 7)
    assert v.count() - 3 * t.count() // 2 + t.count() == 2
    rim = t.select(F.explode(F.array(*[F.array(F.least(F.get("vtx", F.lit(a)), F.get("vtx", F.lit(b))), F.greatest(F.get("vtx", F.lit(a)), F.get("vtx", F.lit(b)))) for a, b in ((0, 1), (1, 2), (2, 0))])).alias("e"))
    assert rim.groupBy("e").count().where("count <> 2").count() == 0


def test_hilbert_is_a_walk(spark):
    cells = spark.range(32 * 32).select((F.col("id") % 32).alias("x"), F.expr("id div 32").alias("y"))
    walk = cells.withColumn("k", sfc.hilbert2(F.col("x"), F.col("y"), 5)).orderBy("k").collect()
    assert [r.k for r in walk] == list(range(1024))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(walk, walk[1:], strict=False))


def test_hilbert_in_space(spark):
    for n, level in ((8, 3), (2, 1)):
        cells = spark.range(n**3).select((F.col("id") % n).alias("x"), F.expr(f"id div {n} % {n}").alias("y"), F.expr(f"id div {n * n}").alias("z"))
        walk = cells.withColumn("k", sfc.hilbert([F.col("x"), F.col("y"), F.col("z")], level)).orderBy("k").collect()
        assert [r.k for r in walk] == list(range(n**3))
        assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(walk, walk[1:], strict=False))


def test_nearest_and_triangles(spark):
    cloud = generators.random_cloud(spark, 400, seed=4)
    v, t = generators.sphere(spark, 16, 9, 0.5)
    v = v.select("gnum", *[(F.col(a) + 0.5).alias(a) for a in "xyz"])
    tri = t.withColumn("gnum", F.monotonically_increasing_id()).select("gnum", F.posexplode("vtx").alias("pos", "v")).join(v.select(F.col("gnum").alias("v"), F.struct("x", "y", "z").alias("p")), "v")
    tri = tri.groupBy("gnum").agg(*[F.max(F.when(F.col("pos") == k, F.col("p"))).alias(n) for k, n in enumerate("abc")]).cache()
    got = {r.gnum: r.dist2 for r in spatial.distance_to_triangles(cloud, tri).collect()}
    T = [np.array([list(r[c]) for c in "abc"]) for r in tri.collect()]

    def d2(p, q):
        a, b, c = q
        best = min(float(((p - (s + np.clip((p - s) @ (e - s) / ((e - s) @ (e - s)), 0, 1) * (e - s))) ** 2).sum()) for s, e in ((a, b), (b, c), (c, a)))
        n = np.cross(b - a, c - a)
        f = p - n * ((p - a) @ n) / (n @ n)
        if all(np.cross(e - s, f - s) @ n >= 0 for s, e in ((a, b), (b, c), (c, a))):
            best = min(best, float(((p - f) ** 2).sum()))
        return best

    for r in cloud.limit(60).collect():
        p = np.array([r.x, r.y, r.z])
        assert math.isclose(got[r.gnum], min(d2(p, q) for q in T), rel_tol=1e-9, abs_tol=1e-12)


def test_location_reproduces_linear_fields(spark):
    t = with_corners(generators.cube_tetras(spark, 4), generators.cube_vertices(spark, 4))
    pts = generators.random_cloud(spark, 300, seed=2)
    got = spatial.locate_in_tetras(pts, t).join(t, F.col("elt") == t["gnum"]).drop(t["gnum"]).join(pts, "gnum").collect()
    assert len(got) == 300
    for r in got:
        assert abs(sum(w * (2 * p.x - p.y + 3 * p.z) for w, p in zip(r.weights, (r.a, r.b, r.c, r.d), strict=True)) - (2 * r.x - r.y + 3 * r.z)) < 1e-9


def test_isosurface_of_a_sphere(spark):
    v = generators.cube_vertices(spark, 7).withColumn("value", isosurface.field("sphere", 0.5, 0.5, 0.5, 0.33))
    cut = isosurface.triangles(generators.cube_tetras(spark, 7), v)
    edges = cut.select("gnum", F.posexplode("edges").alias("k", "e"), F.size("edges").alias("n"))
    sides = edges.join(edges.select("gnum", F.col("k").alias("k2"), F.col("e").alias("e2")), "gnum").where("k2 = (k + 1) % n")
    pair = F.array_sort(F.array("e", "e2"))
    assert sides.groupBy(pair.alias("p")).count().where("count <> 2").count() == 0
    x = isosurface.crossings(cut.select(F.explode("edges").alias("e")).select("e.v1", "e.v2"), v).collect()
    assert len(x) == edges.select("e").distinct().count()
    assert all(abs(math.dist((r.x, r.y, r.z), (0.5, 0.5, 0.5)) - 0.33) < 0.05 for r in x)


def test_lines_and_boxes(spark):
    boxes = generators.random_boxes(spark, 80, 0.2, seed=1)
    lines = generators.random_cloud(spark, 40, 5).select("gnum", *[F.col(a).alias(f"a{a}") for a in "xyz"]).join(generators.random_cloud(spark, 40, 6).select("gnum", *[F.col(a).alias(f"b{a}") for a in "xyz"]), "gnum")
    got = {(r.gnum, r.b_gnum) for r in spatial.lines_meet_boxes(lines, boxes).collect()}
    want = set()
    for line in lines.collect():
        for b in boxes.collect():
            lo, hi = 0.0, 1.0
            for k in "xyz":
                p, d = line[f"a{k}"], line[f"b{k}"] - line[f"a{k}"]
                t = sorted(((b[f"{k}min"] - p) / d, (b[f"{k}max"] - p) / d))
                lo, hi = max(lo, t[0]), min(hi, t[1])
            if lo <= hi:
                want.add((line.gnum, b.gnum))
    assert got == want and want


def test_splits_and_orders(spark):
    c = generators.random_cloud(spark, 1000, 9)
    for curve in ("morton", "hilbert"):
        sizes = [r["count"] for r in partition.curve_split(c, 7, curve).groupBy("part").count().collect()]
        assert sum(sizes) == 1000 and max(sizes) - min(sizes) <= 2
    chain = spark.createDataFrame([(0, (7 * i) % 40) for i in range(40)], "part int, gnum long")
    edges = spark.createDataFrame([(0, (7 * i) % 40, (7 * (i + 1)) % 40) for i in range(39)], "part int, src long, dst long")
    at = {r.gnum: r.lnum for r in partition.renumber_cuthill(chain, edges).collect()}
    assert max(abs(at[(7 * i) % 40] - at[(7 * (i + 1)) % 40]) for i in range(39)) == 1
    assert sorted(r.lnum for r in partition.RENUMBERINGS["random"](chain).collect()) == list(range(1, 41))
    assert partition.coarsen(chain, 4).select("coarse").distinct().count() == 10


def test_merge_points(spark):
    pts = spark.createDataFrame([(i, i * 0.1 + (5 if i >= 6 else 0), 0.0, 0.0) for i in range(10)], "gnum long, x double, y double, z double")
    assert {r.gnum: r.root for r in spatial.merge_points(pts, 0.11).collect()} == {i: 0 if i < 6 else 6 for i in range(10)}


def test_zero_weights_raise(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, -1.0)], "gnum long, v double, w double")
    try:
        reduce.mean_fields(df, ["v"], "w").collect()
    except Exception as e:
        assert "sum to zero" in str(e)
    else:
        raise AssertionError
