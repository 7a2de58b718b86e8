"""Predicates and planar geometry as column expressions over point structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import geometry as G


def orient2d(a: Column, b: Column, c: Column) -> Column:
    """Positive if a, b, c turn left, in double arithmetic; `orient2d_sure` says whether the sign is safe."""
    return (a["x"] - c["x"]) * (b["y"] - c["y"]) - (a["y"] - c["y"]) * (b["x"] - c["x"])


def orient2d_sure(a: Column, b: Column, c: Column) -> Column:
    """Whether rounding can't have changed the sign of orient2d: its size exceeds the bound of its rounding errors."""
    left, right = (a["x"] - c["x"]) * (b["y"] - c["y"]), (a["y"] - c["y"]) * (b["x"] - c["x"])
    return F.abs(left - right) > F.lit((3 + 16 * 2.0**-53) * 2.0**-53) * (F.abs(left) + F.abs(right))


def in_sphere(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """Positive if e lies in the sphere of a, b, c, d, whose oriented volume is positive; in double arithmetic."""
    p = [G.sub(x, e) for x in (a, b, c, d)]
    q = [G.dot(x, x) for x in p]
    det = lambda i, j, k: G.dot(p[i], G.cross(p[j], p[k]))
    return q[0] * det(1, 2, 3) - q[1] * det(0, 2, 3) + q[2] * det(0, 1, 3) - q[3] * det(0, 1, 2)


def orient3d(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Six times the volume of a, b, c, d, positive if d sees a, b, c clockwise."""
    return -6 * G.tetra_volume(a, b, c, d)


def in_circle(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Positive if d lies in the circle of a, b, c, which turn left."""
    p = [G.sub(x, d) for x in (a, b, c)]
    q = [x["x"] * x["x"] + x["y"] * x["y"] for x in p]
    minor = lambda i, j: p[i]["x"] * p[j]["y"] - p[i]["y"] * p[j]["x"]
    return q[0] * minor(1, 2) - q[1] * minor(0, 2) + q[2] * minor(0, 1)


def line_meet(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """(u, v): where the lines a1 + u (a2 - a1) and b1 + v (b2 - b1) meet in the plane; null if they are parallel."""
    d, e, w = G.sub(a2, a1), G.sub(b2, b1), G.sub(b1, a1)
    det = d["x"] * e["y"] - d["y"] * e["x"]
    safe = F.when(det != 0, det)
    return F.struct(((w["x"] * e["y"] - w["y"] * e["x"]) / safe).alias("u"), ((w["x"] * d["y"] - w["y"] * d["x"]) / safe).alias("v"))


def in_polygon(p: Column, ring: Column) -> Column:
    """Even-odd test in the plane of x and y, for a ring given as an array of points."""
    n = F.size(ring)

    def side(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        crosses = (a["y"] > p["y"]) != (b["y"] > p["y"])
        x = a["x"] + (p["y"] - a["y"]) / F.when(crosses, b["y"] - a["y"]) * (b["x"] - a["x"])
        return F.when(crosses & (p["x"] < x), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), side), F.lit(0), lambda s, x: s + x) % 2 == 1


def mean_values(p: Column, ring: Column) -> Column:
    """Mean value coordinates of a point strictly inside a polygon, in the plane of x and y."""
    n = F.size(ring)

    def half_tan(i: Column) -> Column:
        a, b = G.sub(F.get(ring, i % n), p), G.sub(F.get(ring, (i + 1) % n), p)
        det = a["x"] * b["y"] - a["y"] * b["x"]
        inner = a["x"] * b["x"] + a["y"] * b["y"]
        r = F.sqrt((a["x"] * a["x"] + a["y"] * a["y"]) * (b["x"] * b["x"] + b["y"] * b["y"]))
        return (r - inner) / F.when(det != 0, det)

    def weight(i: Column) -> Column:
        v = G.sub(F.get(ring, i), p)
        return (half_tan(i + n - 1) + half_tan(i)) / F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])

    w = F.transform(F.sequence(F.lit(0), n - 1), weight)
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    return F.transform(w, lambda x: x / total)


def fan(vtx: Column) -> Column:
    """Triangles of a convex polygon, as arrays of three vertex ids."""
    n = F.size(vtx)
    return F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array(F.get(vtx, F.lit(0)), F.get(vtx, i), F.get(vtx, i + 1)))


def lagrange_triangle(order: int, u: Column, v: Column) -> list[Column]:
    """Lagrange weights at (u, v) of the nodes (i / order, j / order), i first, j rows upwards."""
    w = 1 - u - v

    def factor(x: Column, n: int) -> Column:
        out = F.lit(1.0)
        for m in range(n):
            out = out * (order * x - m) / (m + 1)
        return out

    return [factor(u, i) * factor(v, j) * factor(w, order - i - j) for j in range(order + 1) for i in range(order + 1 - j)]


def tuple_hash(columns: list[Column], most: int) -> Column:
    """Sum of the components times their places, modulo `most`: equal for equal tuples."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        out = out + c.cast("long") * (k + 1)
    return F.pmod(out, F.lit(most))


def same_cycle(a: Column, b: Column) -> Column:
    """1 if the tuples are equal up to rotation, -1 up to rotation and reversal, else 0; pairs by order alone."""
    turn = lambda x: F.concat(F.slice(x, F.array_position(x, F.array_min(x)).cast("int"), F.size(x)), F.slice(x, F.lit(1), F.array_position(x, F.array_min(x)).cast("int") - 1))
    flat = F.when(a == b, 1).when(a == F.reverse(b), -1).otherwise(0)
    return F.when(F.size(a) != F.size(b), 0).when(F.size(a) == 2, flat).when(turn(a) == turn(b), 1).when(turn(a) == turn(F.reverse(b)), -1).otherwise(0)
