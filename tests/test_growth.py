"""What is shuffled grows with what is given, not with what is made of it on the way."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lifted_cells_without_their_mesh(spark):
    """The cells over polygons have the shapes that their mesh gives, and only the polygons' corners are shuffled for them."""
    from gridloom.operators import surfaces
    from gridloom.sources.polygonal import lifted, lifted_shapes, polygon_rectangle

    faces, flat = polygon_rectangle(spark, 3, 2, 3.0, 2.0)
    v = flat.withColumn("z", F.sin("x") + F.col("y") * F.col("y"))
    mesh = lifted(faces, v, 3, 2.0)
    rows = lambda d: {r.cell: [r.volume, r.surface, r.open, *r.center] for r in d.collect()}
    want, got = rows(surfaces.cell_shapes(mesh["cell_face"], mesh["face_vtx"], mesh["vertices"])), rows(lifted_shapes(faces, v, 3, 2.0))
    assert want.keys() == got.keys() and len(got) == 3 * faces.count()
    assert all(math.isclose(a, b, abs_tol=1e-12) for c in want for a, b in zip(want[c], got[c], strict=True))
    plan = plan_of(QUERIES["prism_cells"](spark, SF))
    assert plan.count("MapInArrow") == 1 and plan.count("Generate posexplode") == 1


def test_winds_of_elements_without_their_faces(spark, monkeypatch):
    """Elements of all types give what the triangles of their mesh give, and no faces are numbered for the query."""
    from gridloom.functions.tables import materialise
    from gridloom.operators import connectivity, polyhedra, winds
    from gridloom.sources import generators

    cells = materialise(generators.cube_mixed(spark, 4))
    v = generators.cube_vertices(spark, 4).select("gnum", "x", (F.col("y") + 0.1 * F.sin(7 * F.col("x"))).alias("y"), (F.col("z") - 0.2 * F.col("x") * F.col("y")).alias("z"))
    edges = spark.createDataFrame([(k + 1, int(a), int(b)) for k, (a, b) in enumerate(np.random.default_rng(2).integers(1, 65, (60, 2)))], "gnum long, v1 long, v2 long")
    faces, signed = connectivity.descend(cells)
    rows = lambda d: {(r.gnum, r.way): (r.cell, r.x, r.y, r.z) for r in d.collect()}
    want, got = rows(winds.edge_winds(edges, polyhedra.face_triangles(signed, faces), v)), rows(winds.element_winds(edges, cells, v))
    assert want == got and len(got) == 120 and len({c[0] for c in got.values()}) > 20

    def none(*_):
        raise AssertionError("faces are numbered")

    monkeypatch.setattr(connectivity, "descend", none)
    assert QUERIES["edge_winds"](spark, SF).count() > 0


def test_shared_areas_are_those_of_the_overlay(spark):
    """Convex rings of several sizes share in blocks what the overlay links up; rings that aren't convex go through the overlay;
    what only meets in its box shares nothing. The query shuffles rings, not pieces."""
    from gridloom.operators import refinement

    rng = np.random.default_rng(4)

    def grid(n, turn, wave):
        at = {}
        for j in range(n + 1):
            for i in range(n + 1):
                x, y = i / n - 0.5 + wave * rng.uniform(-0.1, 0.1) / n, j / n - 0.5 + wave * rng.uniform(-0.1, 0.1) / n
                at[1 + i + j * (n + 1)] = (x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn))
        low = [1 + i + j * (n + 1) for j in range(n) for i in range(n)]
        rings = [[v, v + 1, v + n + 2, v + n + 1] for v in low]
        rings[0] = rings[0][:3]  # a triangle
        return at, [(k + 1, r) for k, r in enumerate(rings)]

    frames = lambda at, rings: (spark.createDataFrame(rings, "gnum long, vtx array<long>"), spark.createDataFrame([(k, *p) for k, p in at.items()], "gnum long, x double, y double"))
    rows = lambda d: sorted((r.a, r.b, r.area) for r in d.collect())
    left, right = grid(5, 0.0, 1.0), grid(4, 0.4, 1.0)
    dented = (left[0], [(g, r) for g, r in left[1] if r[0] not in (15, 16, 21)] + [(77, [15, 16, 17, 23, 22, 28, 27, 21])])  # three rings as one
    for a in (left, dented):
        mesh = frames(*a), frames(*right)
        want, got = rows(refinement.overlay_meshes(*mesh)["pieces"]), rows(refinement.shared_areas(*mesh))
        assert [x[:2] for x in want] == [x[:2] for x in got] and len(got) > 50
        assert all(math.isclose(x[2], y[2], abs_tol=1e-12) for x, y in zip(want, got, strict=True))
    plan = plan_of(QUERIES["overlay_strips"](spark, SF))
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_lists_travel_packed(spark):
    """Numbers come back from their bytes whatever their size, lists cut within their arrays too; a hot key is found through its
    bucket; what an A gets is shuffled as bytes, and rows are dealt before sets are begun."""
    import pyarrow as pa

    from gridloom.operators import connectivity

    rng = np.random.default_rng(8)
    rows = [sorted({int(x) for x in rng.integers(0, 2 ** int(rng.integers(1, 63)), int(rng.integers(0, 9)))}) for _ in range(300)] + [[], [0], [2**63 - 1], [0, 2**63 - 1], [127, 128, 255, 16511, 16512]]
    data = connectivity.packed(pa.array([list(rng.permutation(r)) if r else [] for r in rows], pa.list_(pa.int64())))
    for x, want in ((data, rows), (data.slice(7, 100), rows[7:107]), (data.slice(3, 0), [])):
        size, v = connectivity.unpacked(x)
        assert size.tolist() == [len(r) for r in want] and v.tolist() == [n for r in want for n in r]
    pairs = spark.range(400).select(F.when(F.col("id") % 2 == 0, 1000).otherwise(F.col("id")).alias("k"), "id")
    assert [tuple(r) for r in connectivity.crowded(pairs, "k", 50).collect()] == [(1000, 200)] and connectivity.crowded(pairs, "k", 200) is None
    far = lambda c: (F.col(c) + 1) * (2**55 + 3)
    ab = spark.range(90).select((F.col("id") % 7).alias("src"), (F.col("id") % 30 + 1).alias("dst"))
    bc = spark.range(200).select((F.col("id") % 40 + 1).alias("src"), far("id").alias("dst")).where("src < 35")
    want = sorted({(a.src, b.dst) for a in ab.collect() for b in bc.collect() if a.dst == b.src})
    assert sorted(map(tuple, connectivity.combine_pairs(ab, bc).collect())) == want
    plan = plan_of(connectivity.combine_pairs(ab, bc))
    assert "MapInArrow" in plan and "partial_collect" not in plan.split("MapInArrow")[0]
