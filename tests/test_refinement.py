"""Overlay of two meshes of polygons, convex or not: pieces tile both, and crossings have one id each."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from gridloom.operators import contours, intersection, refinement, triangulation


def signed(p):
    return sum(p[i - 1][0] * p[i][1] - p[i - 1][1] * p[i][0] for i in range(len(p))) / 2


def test_overlay_of_polygon_meshes(spark):
    rng = np.random.default_rng(17)
    n = 5
    a_pts = {1 + i + j * (n + 1): (i / n + (0.05 * rng.normal() if 0 < i < n else 0), j / n + (0.05 * rng.normal() if 0 < j < n else 0)) for i in range(n + 1) for j in range(n + 1)}
    a_rings = [(1 + i + j * n, [1 + i + j * (n + 1), 2 + i + j * (n + 1), 2 + i + (j + 1) * (n + 1), 1 + i + (j + 1) * (n + 1)]) for i in range(n) for j in range(n)]
    # b: upright strips with zigzag borders, and within one of them a small square of its own
    xs, ys = np.linspace(-0.3, 1.3, 5), np.linspace(-0.31, 1.33, 9)
    b_pts = {1 + i + k * len(xs): (float(x + (0.13 if k % 2 else 0) + 0.01 * rng.random()), float(y + 0.003 * rng.random())) for k, y in enumerate(ys) for i, x in enumerate(xs)}
    line = lambda i: [1 + i + k * len(xs) for k in range(len(ys))]
    b_rings = [(i + 1, line(i + 1) + line(i)[::-1]) for i in range(len(xs) - 1)]
    for pts, rings in ((a_pts, a_rings), (b_pts, b_rings)):
        assert all(signed([pts[v] for v in r]) > 0 for _, r in rings)
    mesh = lambda pts, rings: (spark.createDataFrame(rings, "gnum long, vtx array<long>"), spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in pts.items()], "gnum long, x double, y double"))
    out = refinement.overlay_meshes(mesh(a_pts, a_rings), mesh(b_pts, b_rings))
    points = {r.gnum: r for r in out["points"].collect()}
    pieces = {r.gnum: r for r in out["pieces"].collect()}
    rings = defaultdict(dict)
    for r in out["piece_points"].collect():
        rings[r.src][r.pos] = r.dst
    assert set(rings) == set(pieces) == set(range(1, len(pieces) + 1))
    crossings = [(r.a_edge, r.b_edge) for r in points.values() if r.a_edge is not None]
    sides_of = lambda rings: {tuple(sorted(e)) for _, r in rings for e in zip(r, r[1:] + r[:1], strict=True)}
    apart = lambda p, q, r, s: triangulation.turn(p, q, r) * triangulation.turn(p, q, s) < 0
    each = [(a_pts[v], a_pts[w], b_pts[x], b_pts[y]) for v, w in sides_of(a_rings) for x, y in sides_of(b_rings)]
    assert len(crossings) == len(set(crossings)) == sum(apart(p, q, r, s) and apart(r, s, p, q) for p, q, r, s in each) > 20
    got, sides = defaultdict(float), defaultdict(int)
    for g, ring in rings.items():
        p = [ring[k] for k in range(len(ring))]
        assert abs(signed([(points[v].x, points[v].y) for v in p]) - pieces[g].area) < 1e-12
        got[pieces[g].a, pieces[g].b] += pieces[g].area
        for e in zip(p, p[1:] + p[:1], strict=True):
            sides[e] += 1
    assert max(sides.values()) == 1  # pieces share sides only with a neighbour on the other side
    triangles = lambda pts, ring: [[pts[ring[i]] for i in t] for t in triangulation.ears([pts[v] for v in ring])[0]]
    for a, ra in a_rings:
        total = 0.0
        for b, rb in b_rings:
            want = sum(intersection.area_of(q) for s in triangles(a_pts, ra) for t in triangles(b_pts, rb) if (q := intersection.clipped(s, t)))
            assert abs(got.get((a, b), 0.0) - want) < 1e-10
            total += got.get((a, b), 0.0)
        assert abs(total - signed([a_pts[v] for v in ra])) < 1e-10


def test_loops_move_once(spark):
    """Long loops take no rounds of Spark jobs; a cell has several keys; open chains give nothing, branches an error; cells too
    large for a bucket get the same loops."""
    n = 500
    links = [(0, c, 10 * k + c, 10 * ((k + 7) % n) + c, k + 0.5) for c in range(3) for k in range(n)] + [(1, 5, 1, 2, 0.0), (1, 5, 2, 3, 0.0)]
    df = spark.createDataFrame(links, "a long, b long, start long, stop long, w double")
    sc = spark.sparkContext
    sc.setJobGroup("loops", "")
    rows = contours.ordered_loops(df, ["a", "b"]).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("loops"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6
    assert {(r.a, r.b, r.loop, r.pos, r.point, r.w) for r in rows} == {(0, c, c, k, 10 * (7 * k % n) + c, 7 * k % n + 0.5) for c in range(3) for k in range(n)}
    plain = contours.jumped(df.where("a = 0"), ["a", "b"], 60)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rows))
    with pytest.raises(Exception, match="branch"):
        contours.ordered_loops(spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 1), (1, 3, 1)], "cell long, start long, stop long")).collect()


def test_crossings_of_one_crowded_cell(spark):
    """Level and upright edges, all of which cross: dealt over blocks, with the rings on either side."""
    n = 70
    rows = [(i, float(i), -1.0, float(i), n + 1.0, 2 * i, 2 * i + 1) for i in range(1, n + 1)]
    a = spark.createDataFrame(rows, "edge long, px double, py double, qx double, qy double, f_left long, f_right long")
    b = a.selectExpr("edge", "py px", "px - 0.25 py", "qy qx", "qx - 0.25 qy", "f_left", "IF(edge > 1, f_right, NULL) f_right")
    got = {(r.a_edge, r.b_edge): r for r in refinement.edge_crossings(a, b).collect()}
    assert len(got) == n * n
    for (i, j), r in got.items():
        assert abs(r.x - i) < 1e-12 and abs(r.y - j + 0.25) < 1e-12
        assert (r.a_before, r.a_after, r.b_before, r.b_after) == (2 * j + 1 if j > 1 else None, 2 * j, 2 * i, 2 * i + 1)


def test_turns_are_exact():
    rng = np.random.default_rng(4)
    a, b = rng.random((2, 400, 2))
    c = a + (b - a) * rng.random((400, 1)) + rng.integers(-1, 2, (400, 2)) * 2.0**-53
    want = []
    for p, q, r in zip(a.tolist(), b.tolist(), c.tolist(), strict=True):
        (px, py), (qx, qy), (rx, ry) = ([Fraction(v) for v in x] for x in (p, q, r))
        d = (px - rx) * (qy - ry) - (py - ry) * (qx - rx)
        want.append((d > 0) - (d < 0))
    assert refinement.turns(a, b, c).tolist() == want
    assert refinement.turns(a, a, a).tolist() == [0] * 400


def test_surfaces_take_few_tables(spark, monkeypatch):
    """The points of a level in a row of cubes, one square a cube; however many loops there are, few tables are written."""
    n, made = 12, []
    monkeypatch.setattr(contours, "materialise", lambda df, own=contours.materialise: made.append(df) or own(df))
    at = lambda i, j, k: 4 * i + 2 * j + k + 1
    faces, cells = {}, []

    def face(cell, ring, out):
        f = faces.setdefault(tuple(sorted(ring)), (len(faces) + 1, ring))
        cells.append((cell, len(cells), f[0] if out else -f[0]))

    for c in range(n):
        face(c + 1, [at(c, 0, 0), at(c, 0, 1), at(c, 1, 1), at(c, 1, 0)], c == 0)
        face(c + 1, [at(c + 1, 0, 0), at(c + 1, 1, 0), at(c + 1, 1, 1), at(c + 1, 0, 1)], True)
        face(c + 1, [at(c, 0, 0), at(c + 1, 0, 0), at(c + 1, 0, 1), at(c, 0, 1)], True)
        face(c + 1, [at(c, 1, 0), at(c, 1, 1), at(c + 1, 1, 1), at(c + 1, 1, 0)], True)
        face(c + 1, [at(c, 0, 0), at(c, 1, 0), at(c + 1, 1, 0), at(c + 1, 0, 0)], True)
        face(c + 1, [at(c, 0, 1), at(c + 1, 0, 1), at(c + 1, 1, 1), at(c, 1, 1)], True)
    fv = [(k, i, v) for k, r in faces.values() for i, v in enumerate(r)]
    vs = [(at(i, j, k), float(i), float(j), float(k), float(k)) for i in range(n + 1) for j in (0, 1) for k in (0, 1)]
    long = "src long, pos int, dst long"
    out = contours.iso_surface(spark.createDataFrame(cells, long), spark.createDataFrame(fv, long), spark.createDataFrame(vs, "gnum long, x double, y double, z double, value double"), 0.25)
    assert sorted((r.src, r.pos) for r in out["polygon_points"].collect()) == [(c + 1, p) for c in range(n) for p in range(4)]
    assert sorted(map(tuple, out["polygons"].collect())) == [(c + 1, c + 1) for c in range(n)]
    assert {(r.z, r.t) for r in out["points"].collect()} == {(0.25, 0.25)} and out["points"].count() == 2 * n + 2
    assert len(made) <= 6
