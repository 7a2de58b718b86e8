"""Lines in volumes and on surfaces, surfaces in space, elements before and behind edges."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import connectivity, intersection, polyhedra, winds
from gridloom.sources import generators

rng = np.random.default_rng(21)
LINE = "gnum long, ax double, ay double, az double, bx double, by double, bz double"


def slab(a, b, low, high):
    t0, t1 = 0.0, 1.0
    for p, q, lo, hi in zip(a, b, low, high, strict=True):
        if p == q:
            if not lo <= p <= hi:
                return 0.0
            continue
        u, v = sorted(((lo - p) / (q - p), (hi - p) / (q - p)))
        t0, t1 = max(t0, u), min(t1, v)
    return max(0.0, t1 - t0) * math.dist(a, b)


def test_lines_in_volumes(spark):
    """Against boxes, for cells cut as prisms, pyramids and tetrahedra too; diagonals run along inner faces."""
    lines = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(-0.3, 1.3, (60, 6)))]
    lines += [(100, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (101, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1), (102, 0.125, 0.125, -1.0, 0.125, 0.125, 2.0), (103, 5.0, 5.0, 5.0, 6.0, 6.0, 6.0)]
    n = 5
    mesh = generators.cube_mixed(spark, n), generators.cube_vertices(spark, n)
    got = defaultdict(float)
    for r in intersection.lines_in_volumes(spark.createDataFrame(lines, LINE), mesh).collect():
        got[r.a_gnum, (r.b_gnum - 1) // 6] += r.measure
    hexa = generators.cube_cells(spark, n).withColumn("elt_type", F.lit("hexa"))
    whole = {(r.a_gnum, r.b_gnum - 1): r.measure for r in intersection.lines_in_volumes(spark.createDataFrame(lines, LINE), (hexa, mesh[1])).collect()}
    for g, *p in lines:
        for c in range((n - 1) ** 3):
            low = np.array([c % 4, c // 4 % 4, c // 16]) / 4
            want = slab(p[:3], p[3:], low, low + 0.25)
            assert abs(whole.get((g, c), 0.0) - want) < 1e-12
            if g < 100:
                assert abs(got.get((g, c), 0.0) - want) < 1e-12
    assert not any(k[0] in (101, 103) for k in got)


def test_lines_on_surfaces(spark):
    v, q = generators.rectangle(spark, 5, 5)
    tilt = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    at = {r.gnum: tilt @ [r.x, r.y, 0.0] for r in v.collect()}
    moved = spark.createDataFrame([(k, *map(float, p)) for k, p in at.items()], "gnum long, x double, y double, z double")
    flat = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(-0.2, 1.2, (40, 4)))]
    lines = [(k, *map(float, tilt @ [a, b, 0]), *map(float, tilt @ [c, d, 0])) for k, a, b, c, d in flat]
    lines += [(100, *map(float, tilt @ [0.2, 0.2, 1]), *map(float, tilt @ [0.8, 0.8, 1])), (101, *map(float, tilt @ [0.3, 0.3, -1]), *map(float, tilt @ [0.3, 0.3, 1]))]
    got = {(r.a_gnum, r.b_gnum): r.measure for r in intersection.lines_on_surfaces(spark.createDataFrame(lines, LINE), (q, moved)).collect()}
    assert all(m < 1e-8 for (g, _), m in got.items() if g >= 100)  # above the surface, or through it within the tolerance
    for k, a, b, c, d in flat:
        for cell in range(16):
            low = (cell % 4 / 4, cell // 4 / 4)
            assert abs(got.get((k, cell + 1), 0.0) - slab((a, b), (c, d), low, (low[0] + 0.25, low[1] + 0.25))) < 1e-9


def test_surfaces_in_space(spark):
    tilt = np.linalg.qr(rng.normal(size=(3, 3)))[0]

    def surface(n, shift=(0.0, 0.0, 0.0)):
        v, q = generators.rectangle(spark, n, n)
        rows = [(r.gnum, *map(float, tilt @ (np.array([r.x, r.y, 0.0]) + shift))) for r in v.collect()]
        return q, spark.createDataFrame(rows, "gnum long, x double, y double, z double")

    got = {(r.a_gnum, r.b_gnum): r.measure for r in intersection.intersect_surfaces(surface(4), surface(5, (0.1, -0.05, 0)), least=1e-12).collect()}
    for i in range(9):
        for j in range(16):
            side = [max(0.0, min((i // m % 3 + 1) / 3, (j // k % 4 + 1) / 4 + s) - max(i // m % 3 / 3, j // k % 4 / 4 + s)) for m, k, s in ((1, 1, 0.1), (3, 4, -0.05))]
            want = side[0] * side[1]
            assert abs(got.get((i + 1, j + 1), 0.0) - (want if want > 1e-12 else 0)) < 1e-10
    same = {(r.a_gnum, r.b_gnum): r.measure for r in intersection.intersect_surfaces(surface(4), surface(4), least=1e-12).collect()}
    assert len(same) == 9 and all(a == b and abs(m - 1 / 9) < 1e-12 for (a, b), m in same.items())
    assert intersection.intersect_surfaces(surface(3), surface(3, (0, 0, 0.01))).count() == 0


def test_winds(spark):
    """In a mesh of four element types: the ray's own midpoint just beyond the vertex tells which cells it enters."""
    n = 5
    e, v = generators.cube_mixed(spark, n), generators.cube_vertices(spark, n)
    faces, cf = connectivity.descend(e)
    t = polyhedra.face_triangles(cf, faces)
    at = {r.gnum: np.array([r.x, r.y, r.z]) for r in v.collect()}
    own = {r.gnum: (r.elt_type, r.vtx) for r in e.collect()}
    planes = defaultdict(list)
    for r in t.collect():
        a, b, c = at[r.v1], at[r.v2], at[r.v3]
        planes[r.cell].append((np.cross(b - a, c - a), a))
    edges, seen = [], set()
    for cell, (_, vtx) in own.items():
        for k in range(len(vtx)):
            pair = vtx[k - 1], vtx[k]
            if pair not in seen and rng.random() < 0.15:
                seen.add(pair)
                edges.append((len(edges), *pair))
    rows = {(r.gnum, r.way): r for r in winds.edge_winds(spark.createDataFrame(edges + [(9999, 1, 1)], "gnum long, v1 long, v2 long"), t, v).collect()}
    assert rows[9999, "up"].cell is None and len(rows) == 2 * len(edges) + 2
    some = 0
    for g, a, b in edges:
        for way, o, d in (("up", at[a], at[a] - at[b]), ("down", at[b], at[b] - at[a])):
            p = o + 1e-4 * d
            inside = [c for c in own if all(n @ (p - q) <= 1e-9 * np.linalg.norm(n) for n, q in planes[c])]
            assert rows[g, way].cell == (min(inside) if inside else None), (g, way)
            if inside:
                some += 1
                x = np.array([rows[g, way].x, rows[g, way].y, rows[g, way].z])
                assert np.linalg.norm(np.cross(x - o, d)) < 1e-9 and (x - o) @ d > 0
    assert some > 20
