"""Iso-surfaces of tetrahedra and fields on vertices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.elements import tetras_of

TETRA_EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))

FIELDS = {
    "plane": lambda x, y, z, a, b, c, d: a * x + b * y + c * z - d,
    "sphere": lambda x, y, z, a, b, c, r: (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 - r * r,
    "quadric": lambda x, y, z, a, b, c, d, e, f, g, h, i, j: a * x * x + b * y * y + c * z * z + d * x * y + e * y * z + f * z * x + g * x + h * y + i * z + j,
    "ellipse": lambda x, y, z, a, b, c, p, q, r, s: ((x - a) / p) ** 2 + ((y - b) / q) ** 2 + ((z - c) / r) ** 2 - s * s,
}


def register_field(name: str, function) -> None:
    """A field of the columns x, y, z and its coefficients."""
    FIELDS[name] = function


def field(kind: str, *coefficients: float) -> Column:
    """A field of the columns x, y, z."""
    return FIELDS[kind](F.col("x"), F.col("y"), F.col("z"), *[F.lit(float(c)) for c in coefficients])


def crossings(edges: DataFrame, vertices: DataFrame, levels: Sequence[float] = (0.0,), tolerance: float = 0.0) -> DataFrame:
    """edges (v1, v2), vertices (gnum, x, y, z, value). (level, v1, v2, t, x, y, z) of the edges that a level crosses: one
    end above it by more than the tolerance, the other not; t is the weight of v2. A vertex on the level counts as below,
    as in `triangles`, so an edge from it upwards is crossed in that vertex."""
    ends = edges.select(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2")).distinct()
    for k in ("1", "2"):
        ends = ends.join(vertices.select(*[F.col(c).alias({"gnum": f"v{k}"}.get(c, f"{c}{k}")) for c in ("gnum", "x", "y", "z", "value")]), f"v{k}")
    out = ends.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    a, b = F.col("value1") - F.col("level"), F.col("value2") - F.col("level")
    out = out.where((a > tolerance) != (b > tolerance)).withColumn("t", F.abs(a / (a - b)))
    return out.select("level", "v1", "v2", "t", *[(F.col(f"{c}1") * (1 - F.col("t")) + F.col(f"{c}2") * F.col("t")).alias(c) for c in ("x", "y", "z")])


def on_level(vertices: DataFrame, levels: Sequence[float] = (0.0,), tolerance: float = 0.0) -> DataFrame:
    """(level, gnum): the vertices whose value is on a level within the tolerance."""
    out = vertices.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    return out.where(F.abs(F.col("value") - F.col("level")) <= tolerance).select("level", "gnum")


def cut_elements(elements: DataFrame, vertices: DataFrame, level: float = 0.0) -> DataFrame:
    """(gnum, edges, parent) of tetrahedra, pyramids, prisms and hexahedra, cut tetrahedron by tetrahedron;
    `tetras_of` splits a face alike from both sides."""
    parts = tetras_of(elements)
    return triangles(parts, vertices, level).join(parts.select("gnum", "parent"), "gnum")


def triangles(tetras: DataFrame, vertices: DataFrame, level: float = 0.0) -> DataFrame:
    """tetras (gnum, vtx array of 4). (gnum, edges): the crossed edges of each cut tetrahedron as pairs of vertex ids,
    three of them or, in cyclic order, four."""
    sign = vertices.select(F.col("gnum").alias("v"), (F.col("value") > level).alias("up"))
    at = tetras.select("gnum", F.posexplode("vtx").alias("pos", "v")).join(sign, "v")
    ups = at.groupBy("gnum").agg(F.array_sort(F.collect_list(F.struct("pos", "v", "up"))).alias("c"))
    high, low = F.filter("c", lambda x: x["up"]), F.filter("c", lambda x: ~x["up"])
    pair = lambda p, q: F.struct(F.least(p["v"], q["v"]).alias("v1"), F.greatest(p["v"], q["v"]).alias("v2"))
    g = lambda s, i: F.get(s, F.lit(i))
    one = lambda s, o: F.array(*[pair(g(s, 0), g(o, i)) for i in range(3)])
    two = F.array(pair(g(high, 0), g(low, 0)), pair(g(high, 0), g(low, 1)), pair(g(high, 1), g(low, 1)), pair(g(high, 1), g(low, 0)))
    n = F.size(high)
    cut = F.when(n == 1, one(high, low)).when(n == 3, one(low, high)).when(n == 2, two)
    return ups.where(n.between(1, 3)).select("gnum", cut.alias("edges"))


def cells_to_vertices(cell_vtx: DataFrame, values: DataFrame) -> DataFrame:
    """Cell field to vertices: the mean of the cells around each vertex."""
    return cell_vtx.join(values.withColumnRenamed("gnum", "src"), "src").groupBy(F.col("dst").alias("gnum")).agg(F.avg("value").alias("value"))
