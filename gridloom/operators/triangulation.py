"""Triangulation of simple polygons, convex or not, in the plane or in space.

A polygon is cut ear by ear: a convex corner whose triangle holds no reflex corner goes. Edges between two triangles of
which a circle holds the fourth corner are then flipped, until the triangulation is the Delaunay one within the ring.
Polygons are rows of their own, so the work is a table function over Arrow batches; n corners give n - 2 triangles, which
walk as the ring does.

Defined results: rings of under three corners give nothing; corners on a straight side stay, at the cost of triangles
without area where nothing else can hold them; a ring that crosses itself gives n - 2 triangles too, with `simple` false;
null rings and rings with an unknown vertex give nothing.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turn(p, q, r) -> int:
    """1 if p, q, r turn left, -1 right, 0 neither; exact."""
    left, right = (p[0] - r[0]) * (q[1] - r[1]), (p[1] - r[1]) * (q[0] - r[0])
    if abs(left - right) > 4e-16 * (abs(left) + abs(right)):
        return 1 if left > right else -1
    (a, b), (c, d), (e, f) = [(Fraction(x), Fraction(y)) for x, y in (p, q, r)]
    det = (a - e) * (d - f) - (b - f) * (c - e)
    return (det > 0) - (det < 0)


def flattened(points: np.ndarray) -> list[tuple[float, float]]:
    """Points of a polygon in its own plane, so that it turns left; coordinates stay as they are where that is one of two
    axes."""
    after = np.roll(points, -1, axis=0)
    normal = np.cross(points - points[0], after - points[0]).sum(axis=0)
    k = int(np.abs(normal).argmax())
    u, w = np.eye(3)[[(k + 1) % 3, (k + 2) % 3] if normal[k] >= 0 else [(k + 2) % 3, (k + 1) % 3]]
    if np.count_nonzero(normal) > 1:
        normal = normal / np.linalg.norm(normal)
        u = u - (u @ normal) * normal
        u = u / np.linalg.norm(u)
        w = np.cross(normal, u)
    return list(zip((points @ u).tolist(), (points @ w).tolist(), strict=True))


def ears(p: list[tuple[float, float]]) -> tuple[list[tuple[int, int, int]], bool]:
    """The triangles of a ring, as places in it, and whether every one was a proper ear."""
    n = len(p)
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    bend = [turn(p[before[i]], p[i], p[after[i]]) for i in range(n)]
    reflex = {i for i in range(n) if bend[i] <= 0}
    out, simple, left, i, tried, least = [], True, n, 0, 0, 1

    def free(a: int, b: int, c: int) -> bool:
        corners = (p[a], p[b], p[c])
        x0, x1, y0, y1 = min(q[0] for q in corners), max(q[0] for q in corners), min(q[1] for q in corners), max(q[1] for q in corners)
        for j in reflex:
            q = p[j]
            if j not in (a, b, c) and x0 <= q[0] <= x1 and y0 <= q[1] <= y1 and q not in corners and turn(p[a], p[b], q) >= 0 and turn(p[b], p[c], q) >= 0 and turn(p[c], p[a], q) >= 0:
                return False
        return True

    while left > 3:
        a, c = before[i], after[i]
        if bend[i] >= least and (least < 0 or free(a, i, c)):
            out.append((a, i, c))
            after[a], before[c], left, tried = c, a, left - 1, 0
            reflex.discard(i)
            simple, least = simple and least >= 0, 1
            for j in (a, c):
                bend[j] = turn(p[before[j]], p[j], p[after[j]])
                (reflex.add if bend[j] <= 0 else reflex.discard)(j)
            i = a
        else:
            i, tried = c, tried + 1
            if tried > left:  # a corner on a straight side, and where there is none either, any corner
                least, tried = least - 1, 0
    out.append((before[i], i, after[i]))
    return out, simple


def in_circle(p, q, r, s) -> bool:
    """Whether s lies in the circle of p, q, r, which turn left, by more than rounding can say."""
    m = [(a[0] - s[0], a[1] - s[1]) for a in (p, q, r)]
    lift = [x * x + y * y for x, y in m]
    parts = [lift[k] * (m[k - 2][0] * m[k - 1][1] - m[k - 2][1] * m[k - 1][0]) for k in range(3)]
    sizes = sum(lift[k] * (abs(m[k - 2][0] * m[k - 1][1]) + abs(m[k - 2][1] * m[k - 1][0])) for k in range(3))
    return sum(parts) > 1e-12 * sizes


def flipped(p: list[tuple[float, float]], triangles: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The triangles after flips towards Delaunay; sides of the ring belong to one triangle and stay."""
    held = dict(enumerate(triangles))
    side = {(t[k], t[k - 2]): i for i, t in held.items() for k in range(3)}
    todo = [e for e in side if e[0] < e[1] and (e[1], e[0]) in side]
    while todo:
        a, b = todo.pop()
        if (a, b) not in side or (b, a) not in side:
            continue
        i, j = side[a, b], side[b, a]
        c = next(v for v in held[i] if v not in (a, b))
        d = next(v for v in held[j] if v not in (a, b))
        if turn(p[a], p[d], p[c]) <= 0 or turn(p[d], p[b], p[c]) <= 0:
            continue  # not convex: the other diagonal doesn't lie inside
        if turn(p[a], p[b], p[c]) > 0 and turn(p[b], p[a], p[d]) > 0 and not in_circle(p[a], p[b], p[c], p[d]):
            continue
        del side[a, b], side[b, a]
        held[i], held[j] = (a, d, c), (d, b, c)
        for k, t in ((i, held[i]), (j, held[j])):
            side.update({(t[m], t[m - 2]): k for m in range(3)})
        todo += [(a, d), (d, b), (b, c), (c, a)]
    return [held[i] for i in sorted(held)]


def triangulate(polygons: DataFrame, vertices: DataFrame, delaunay: bool = True) -> DataFrame:
    """polygons: (gnum, vtx), vertices: (gnum, x, y, z). (gnum, pos, vtx, simple): the triangles of each polygon, numbered
    from 0, as arrays of three vertices."""
    at = polygons.select("gnum", F.posexplode("vtx").alias("pos", "v")).join(vertices.select(F.col("gnum").alias("v"), *[F.col(a).cast("double") for a in "xyz"]), "v")
    rings = at.groupBy("gnum").agg(F.array_sort(F.collect_list(F.struct("pos", "v", "x", "y", "z"))).alias("ring"))  # a polygon's corners
    whole = rings.join(polygons.select("gnum", F.size("vtx").alias("n")), "gnum").where("size(ring) = n AND n > 2").select("gnum", *[F.col(f"ring.{c}").alias(c) for c in "vxyz"])

    def run(batches):
        for batch in batches:
            out = []
            for g, v, *xyz in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                p = flattened(np.array(xyz, np.float64).T)
                found, simple = ears(p)
                if delaunay and simple:
                    found = flipped(p, found)
                out += [(g, k, [v[i] for i in t], simple) for k, t in enumerate(found)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["gnum", "pos", "vtx", "simple"])

    typed = whole.select(F.col("gnum").cast("long"), F.col("v").cast("array<long>"), *"xyz")
    return typed.mapInArrow(run, "gnum long, pos int, vtx array<long>, simple boolean")
