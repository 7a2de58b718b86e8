"""Geometry as column expressions over structs with fields x, y, z, so that it stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def point(x, y, z) -> Column:
    cast = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(cast(x).alias("x"), cast(y).alias("y"), cast(z).alias("z"))


def add(a: Column, b: Column) -> Column:
    return point(*[a[k] + b[k] for k in AXES])


def sub(a: Column, b: Column) -> Column:
    return point(*[a[k] - b[k] for k in AXES])


def scale(a: Column, s: Column) -> Column:
    return point(*[a[k] * s for k in AXES])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def dist2(a: Column, b: Column) -> Column:
    return dot(sub(a, b), sub(a, b))


def triangle_vector(a: Column, b: Column, c: Column) -> Column:
    """Area vector: half the cross product."""
    return scale(cross(sub(b, a), sub(c, a)), F.lit(0.5))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    v = triangle_vector(a, b, c)
    return F.sqrt(dot(v, v))


def polygon_area(points: Column) -> Column:
    """Area of a planar polygon, given as an array of points in order."""
    n = F.size(points)
    first = points[0]
    fan = F.transform(F.sequence(F.lit(1), n - 2), lambda i: triangle_vector(first, F.get(points, i), F.get(points, i + 1)))
    total = F.aggregate(fan, point(0, 0, 0), add)
    return F.when(n >= 3, F.sqrt(dot(total, total))).otherwise(0.0)


def tetra_volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Oriented volume."""
    return dot(cross(sub(b, a), sub(c, a)), sub(d, a)) / 6


def hexa_volume(p: list[Column]) -> Column:
    """Oriented volume of a hexahedron as six tetrahedra around its first diagonal."""
    return sum((tetra_volume(p[a], p[b], p[c], p[d]) for a, b, c, d in HEXA_TETRAS[1:]), tetra_volume(*[p[i] for i in HEXA_TETRAS[0]]))


#: Six tetrahedra of a hexahedron with vertices 0-3 at the bottom and 4-7 above them, all around the diagonal 0-6.
HEXA_TETRAS = ((0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6))
#: The six faces of such a hexahedron, outward.
HEXA_FACES = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))
TETRA_FACES = ((0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3))
PRISM_FACES = ((0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5))
PYRAMID_FACES = ((0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4))
ELEMENT_FACES = {"tetra": TETRA_FACES, "hexa": HEXA_FACES, "prism": PRISM_FACES, "pyramid": PYRAMID_FACES, "triangle": ((0, 1), (1, 2), (2, 0)), "quad": ((0, 1), (1, 2), (2, 3), (3, 0))}


def barycentric(p: Column, a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """The four weights of p in a tetrahedron; null if it is flat."""
    v = tetra_volume(a, b, c, d)
    v = F.when(F.abs(v) > 0, v)
    return [tetra_volume(p, b, c, d) / v, tetra_volume(a, p, c, d) / v, tetra_volume(a, b, p, d) / v, tetra_volume(a, b, c, p) / v]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions over points would else repeat it in each component."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def closest_on_segment(p: Column, a: Column, b: Column) -> Column:
    def at(s: Column) -> Column:
        t = F.when(s["n"] > 0, s["m"] / s["n"]).otherwise(0.0)
        return let(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), lambda u: add(s["a"], scale(s["d"], u)))

    ends = F.struct(a.alias("a"), sub(b, a).alias("d"), sub(p, a).alias("e"))
    return let(ends, lambda s: let(F.struct(s["a"].alias("a"), s["d"].alias("d"), dot(s["d"], s["d"]).alias("n"), dot(s["e"], s["d"]).alias("m")), at))


def closest_on_triangle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """The foot of the perpendicular where it falls inside, else the nearest point of the three edges."""

    def of(t: Column) -> Column:
        sides = F.struct(sub(t["b"], t["a"]).alias("u"), sub(t["c"], t["a"]).alias("v"), sub(t["p"], t["a"]).alias("w"))
        foot = let(sides, lambda s: let(cross(s["u"], s["v"]), lambda n: inner(t, s, n)))
        near = let(F.array(*[closest_on_segment(t["p"], t[x], t[y]) for x, y in ("ab", "bc", "ca")]), lambda q: F.array_min(F.transform(q, lambda x: F.struct(dist2(t["p"], x).alias("d"), x.alias("q"))))["q"])
        return F.coalesce(foot, near)

    def inner(t: Column, s: Column, n: Column) -> Column:
        nn = F.when(dot(n, n) > 0, dot(n, n))
        weights = F.struct((dot(cross(s["w"], s["v"]), n) / nn).alias("v"), (dot(cross(s["u"], s["w"]), n) / nn).alias("w"))
        return let(weights, lambda k: F.when((k["v"] >= 0) & (k["w"] >= 0) & (k["v"] + k["w"] <= 1), add(t["a"], add(scale(s["u"], k["v"]), scale(s["v"], k["w"])))))

    return let(F.struct(p.alias("p"), a.alias("a"), b.alias("b"), c.alias("c")), of)


def segment_hits_box(a: Column, b: Column, low: Column, high: Column) -> Column:
    """Slab test of a closed segment against a closed box."""
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for k in AXES:
        d = b[k] - a[k]
        safe = F.when(d != 0, d)
        t1, t2 = (low[k] - a[k]) / safe, (high[k] - a[k]) / safe
        enter = F.greatest(enter, F.coalesce(F.least(t1, t2), F.lit(0.0)))
        leave = F.least(leave, F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
        outside = outside | ((d == 0) & ((a[k] < low[k]) | (a[k] > high[k])))
    return ~outside & (enter <= leave)
