"""Triangulation of general polygons, iso-surfaces of polyhedra."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import contours, triangulation
from gridloom.sources import generators


def area(p):
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def rings():
    rng = np.random.default_rng(8)
    out = []
    for i in range(60):
        n = int(rng.integers(3, 40))
        angle = np.sort(rng.uniform(0, 2 * math.pi, n))
        if (np.diff(np.append(angle, angle[0] + 2 * math.pi)) >= 3.1).any():
            continue
        r = rng.uniform(0.1, 1, n)
        out.append([(float(a), float(b)) for a, b in zip(r * np.cos(angle), r * np.sin(angle), strict=True)])
    out.append([(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (0, 2), (0, 1)])  # straight sides
    comb = [(x, y) for k in range(20) for x, y in ((2 * k, 0.1), (2 * k + 0.5, 5), (2 * k + 1, 5), (2 * k + 1.5, 0.1))]
    out.append([*[(40, 0), (-1, 0)][::-1], *comb[::-1]])
    spiral = [(math.cos(t) * (1 + t), math.sin(t) * (1 + t)) for t in np.linspace(0, 12, 80)]
    out.append(spiral + [(x * 0.93, y * 0.93) for x, y in spiral[::-1]])
    return [[(float(x), float(y)) for x, y in (r if area(r) > 0 else r[::-1])] for r in out]


@pytest.mark.parametrize("delaunay", [True, False])
def test_triangulation(spark, delaunay):
    tilt = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    polygons, vertices = [], []
    for g, ring in enumerate(rings()):
        base = len(vertices)
        for x, y in ring:
            p = tilt @ [x, y, 3.0] if g % 2 else np.array([x, y, 0.0])
            vertices.append((len(vertices) + 1, *map(float, p)))
        polygons.append((g, list(range(base + 1, len(vertices) + 1))))
    odd = [(1000, [1, 2]), (1001, []), (1002, None), (1003, [1, 2, 10**9])]
    got = triangulation.triangulate(spark.createDataFrame(polygons + odd, "gnum long, vtx array<long>"), spark.createDataFrame(vertices, "gnum long, x double, y double, z double"), delaunay).collect()
    by = {}
    for r in got:
        assert r.simple
        by.setdefault(r.gnum, []).append(r.vtx)
    assert set(by) == {g for g, _ in polygons}
    for (g, vtx), ring in zip(polygons, rings(), strict=True):
        place = {v: ring[k] for k, v in enumerate(vtx)}
        assert len(by[g]) == len(vtx) - 2
        parts = [area([place[v] for v in t]) for t in by[g]]
        assert min(parts) >= -1e-12 and math.isclose(sum(parts), area(ring), rel_tol=1e-9)  # no overlap: all turn left and add up
        sides = Counter((t[k], t[k - 2]) for t in by[g] for k in range(3))
        assert max(sides.values()) == 1
        assert {e for e in sides if (e[1], e[0]) not in sides} == set(zip(vtx, vtx[1:] + vtx[:1], strict=True))
        if delaunay:
            for a, b in sides:
                if (b, a) in sides:
                    c, d = (next(v for t in by[g] if (x, y) in [(t[k], t[k - 2]) for k in range(3)] for v in t if v not in (x, y)) for x, y in ((a, b), (b, a)))
                    q = [place[v] for v in (a, b, c, d)]
                    convex = triangulation.turn(q[0], q[3], q[2]) > 0 and triangulation.turn(q[3], q[1], q[2]) > 0
                    assert not (convex and triangulation.in_circle(*q))


def test_crossing_ring_is_told():
    found, simple = triangulation.ears([(0, 0), (2, 0), (0, 1), (2, 1), (1, -3)])
    assert len(found) == 3 and not simple


def polyhedra(spark, n):
    """A cube of hexahedra as cells given by faces, two neighbouring ones merged into one cell of ten faces."""
    f = generators.cube_faces(spark, n)
    at = F.col("group")
    low = F.when(at % 2 == 1, F.lit(0)).otherwise(F.col("c1"))
    high = F.when(at % 2 == 1, F.col("c1")).otherwise(F.col("c2"))
    both = f.select("gnum", low.alias("low"), high.alias("high"))
    both = both.select("gnum", *[F.when(F.col(c) == 2, 1).otherwise(F.col(c)).alias(c) for c in ("low", "high")]).where("low <> high")
    cf = both.where("low > 0").select(F.col("low").alias("src"), F.lit(0).alias("pos"), F.col("gnum").alias("dst")).unionByName(both.where("high > 0").select(F.col("high").alias("src"), F.lit(0).alias("pos"), (-F.col("gnum")).alias("dst")))
    ring = F.when(F.col("axis") == 1, F.reverse("vtx")).otherwise(F.col("vtx"))
    fv = f.join(both.select("gnum"), "gnum").select(F.col("gnum").alias("src"), F.posexplode(ring).alias("pos", "dst"))
    return cf, fv


@pytest.mark.parametrize("kind", ["sphere", "noise"])
def test_iso_surface_of_polyhedra(spark, kind):
    n = 6
    cf, fv = polyhedra(spark, n)
    v = generators.cube_vertices(spark, n, 2.0, (-1.0, -1.0, -1.0))
    value = 0.6 - F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) if kind == "sphere" else F.rand(3) - 0.5
    v = spark.createDataFrame(v.withColumn("value", value).collect(), "gnum long, x double, y double, z double, value double")
    out = contours.iso_surface(cf, fv, v)
    values = {r.gnum: r for r in v.collect()}
    points = {r.gnum: r for r in out["points"].collect()}
    for p in points.values():  # parents, weights and places
        a, b = values[p.v1], values[p.v2]
        assert (a.value > 0) != (b.value > 0) and 0 <= p.t <= 1 and abs(a.value * (1 - p.t) + b.value * p.t) < 1e-12
        assert all(abs(getattr(a, k) * (1 - p.t) + getattr(b, k) * p.t - getattr(p, k)) < 1e-12 for k in "xyz")
    assert len({(p.v1, p.v2) for p in points.values()}) == len(points)
    loops = {}
    for r in out["polygon_points"].collect():
        loops.setdefault(r.src, {})[r.pos] = r.dst
    assert set(loops) == {r.gnum for r in out["polygons"].collect()} == set(range(1, len(loops) + 1))
    sides = Counter()
    for ring in loops.values():
        ring = [ring[k] for k in range(len(ring))]
        assert len(ring) >= 3 or kind == "noise"
        sides.update(zip(ring, ring[1:] + ring[:1], strict=True))
    lines = {(r.start, r.stop) for r in out["lines"].collect()}
    rim = {e for e in sides if (e[1], e[0]) not in sides}
    assert max(sides.values()) == 1 and {e for s in sides for e in (s, s[::-1])} == {e for s in lines for e in (s, s[::-1])}
    if kind == "sphere":
        assert not rim
        volume = 0.0
        for ring in loops.values():
            p = [np.array([getattr(points[ring[k]], c) for c in "xyz"]) for k in range(len(ring))]
            volume += sum(np.dot(p[0], np.cross(p[k], p[k + 1])) for k in range(1, len(p) - 1)) / 6
        assert 0.7 * 4 / 3 * math.pi * 0.6**3 < volume < 4 / 3 * math.pi * 0.6**3  # outward, and inside the sphere
    else:
        border = {r.src for r in fv.join(cf.groupBy(F.abs("dst").alias("src")).count().where("count = 1"), "src").select("src").distinct().collect()}
        assert len(rim) == sum(r.face in border for r in out["lines"].collect())


def test_loops_of_any_length(spark):
    rng = np.random.default_rng(2)
    links, want = [], {}
    for cell, n in enumerate([2, 3, 5, 8, 300]):
        for part in range(2):
            ring = (rng.permutation(n) + 1000 * part).tolist()
            links += [(cell, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
            k = ring.index(min(ring))
            want[cell, min(ring)] = ring[k:] + ring[:k]
    got = {}
    for r in contours.ordered_loops(spark.createDataFrame(links, "cell long, start long, stop long")).collect():
        got.setdefault((r.cell, r.loop), {})[r.pos] = r.point
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
