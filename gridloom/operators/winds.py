"""The element that lies before and behind each edge of a volume mesh.

From an edge's second vertex a ray goes on along the edge; the element around that vertex that it enters lies downwind. The one
that the ray the other way from the first vertex enters lies upwind. A ray enters an element if it leaves it again through
a face without the vertex, so faces of all elements around the vertex are cut with the ray.

Defined results: a ray along a face or an edge lies in several elements, of which the smallest counts, and of its faces
the smallest; an edge that ends on the border, where its ray leaves the mesh, has nulls there; edges without length have
nulls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import ELEMENT_FACES
from gridloom.functions.tables import materialise

SLACK = 1e-10


def hits(o: np.ndarray, d: np.ndarray, corners: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rays (count, 3) and triangles (count, 3 corners, 3): which meet, and how many lengths of d away."""
    e, f, g = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0], o - corners[:, 0]
    dot = lambda x, y: np.einsum("ki,ki->k", x, y)
    h, q = np.cross(d, f), np.cross(g, e)
    det, size = dot(e, h), np.sqrt(dot(d, d) * dot(e, e) * dot(f, f))
    fine = np.abs(det) > 1e-12 * size
    safe = np.where(fine, det, 1)
    # the place o + s d = t1 + a (t2 - t1) + b (t3 - t1)
    a, b, s = dot(g, h) / safe, dot(d, q) / safe, dot(f, q) / safe
    return fine & (a >= -slack) & (b >= -slack) & (a + b <= 1 + slack) & (s > slack), s


def edge_winds(edges: DataFrame, triangles: DataFrame, vertices: DataFrame, slack: float = SLACK) -> DataFrame:
    """edges: (gnum, v1, v2); triangles: (cell, v1, v2, v3), as of polyhedra.face_triangles; vertices: (gnum, x, y, z).
    (gnum, way, cell, x, y, z): way is `up` or `down`, with the cell and the place where the ray leaves it."""
    t = materialise(triangles.select(F.col("cell").cast("long"), F.array(*[F.col(f"v{k}").cast("long") for k in "123"]).alias("t")))
    around = materialise(t.select("cell", F.explode("t").alias("v")).distinct())
    held = around.join(spots(vertices), "v").groupBy("cell").agg(F.collect_list(F.struct("v", "p")).alias("c"))  # a cell's corners
    cells = held.join(t.groupBy("cell").agg(F.flatten(F.collect_list("t")).alias("t")), "cell")
    # what cites a vertex without a place is no triangle
    known = F.filter(F.sequence(F.lit(0), F.size("t") - 3, F.lit(3)), lambda k: F.forall(F.slice("t", k + 1, 3), lambda v: F.array_contains("c.v", v)))
    own = F.flatten(F.transform(known, lambda k: F.slice("t", k + 1, 3)))
    return winds_of(edges, vertices, around, cells.select("cell", F.col("c.v").alias("vtx"), F.flatten("c.p").alias("p"), places_in(own, F.col("c.v")).alias("t")), slack)


def element_winds(edges: DataFrame, elements: DataFrame, vertices: DataFrame, slack: float = SLACK) -> DataFrame:
    """edge_winds of elements (gnum, elt_type, vtx), tetrahedra, pyramids, prisms and hexahedra, whose vertices all have a
    place: an element's triangles come from its own corners, without the mesh's faces."""
    corners = elements.select(F.col("gnum").cast("long").alias("cell"), "elt_type", F.posexplode("vtx").alias("pos", "v")).withColumn("v", F.col("v").cast("long"))
    # dealt as plain rows: lists begun before the shuffle would be longer than they
    held = corners.join(spots(vertices), "v").select("cell", "elt_type", "pos", "v", *[F.get("p", F.lit(k)).alias(a) for k, a in enumerate("xyz")]).repartition("cell").groupBy("cell", "elt_type")
    held = held.agg(F.array_sort(F.collect_list(F.struct("pos", "v", F.array(*"xyz").alias("p")))).alias("c"))  # an element's corners
    named = held.select("cell", "elt_type", F.col("c.v").alias("vtx"), F.flatten("c.p").alias("p"))
    return winds_of(edges, vertices, corners.select("cell", "v"), named.select("cell", "vtx", "p", fans(F.col("elt_type"), F.col("vtx")).alias("t")), slack)


def spots(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("gnum").cast("long").alias("v"), F.array(*[F.col(a).cast("double") for a in "xyz"]).alias("p"))


def places_in(t: Column, vtx: Column) -> Column:
    """Where the vertices t stand in vtx, from 0."""
    return F.transform(t, lambda v: F.array_position(vtx, v).cast("int") - 1)


def fans(kind: Column, vtx: Column) -> Column:
    """The places in vtx of the corners of an element's triangles, three each: its faces, walked so that the normal points
    out, fan out from their smallest vertices, as in polyhedra.face_triangles."""

    def of(face: tuple[int, ...]) -> Column:
        ids = F.array(*[F.get(vtx, F.lit(i)) for i in face])
        at, own = F.array_position(ids, F.array_min(ids)).cast("int"), F.array(*[F.lit(i) for i in face])
        ring = F.concat(F.slice(own, at, len(face)), F.slice(own, F.lit(1), at - 1))
        return F.array(*[F.get(ring, F.lit(i)) for k in range(1, len(face) - 1) for i in (0, k, k + 1)])

    solids = {name: F.concat(*map(of, faces)) for name, faces in ELEMENT_FACES.items() if len(faces[0]) > 2}
    return F.coalesce(*[F.when(kind == name, t) for name, t in solids.items()], F.array().cast("array<int>"))


def winds_of(edges: DataFrame, vertices: DataFrame, around: DataFrame, cells: DataFrame, slack: float) -> DataFrame:
    """edge_winds, where around is (cell, v), the cells at each vertex, and cells (cell, vtx, p, t): the corners, their places,
    three numbers each, and for each triangle the places of three corners in vtx. A ray goes to the cells at its vertex and
    finds their corners there."""
    spot = lambda v, p: spots(vertices).select(F.col("v").alias(v), F.col("p").alias(p))
    e = edges.select(F.col("gnum").cast("long"), F.col("v1").cast("long"), F.col("v2").cast("long")).join(spot("v1", "p1"), "v1").join(spot("v2", "p2"), "v2")
    away = lambda p, q: [(F.get(p, F.lit(k)) - F.get(q, F.lit(k))).alias(f"d{a}") for k, a in enumerate("xyz")]
    ray = lambda down, v, p, q: F.struct(F.lit(down).alias("down"), F.col(v).alias("v"), *away(p, q))
    rays = materialise(e.select("gnum", F.explode(F.array(ray(False, "v1", "p1", "p2"), ray(True, "v2", "p2", "p1"))).alias("r")).select("gnum", "r.*"))
    met = rays.join(around, "v").join(cells, "cell").select("gnum", "down", "cell", "v", "dx", "dy", "dz", "vtx", "p", "t")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, s, place = entered(batch, slack)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in range(3)], pa.array(s), *[pa.array(np.ascontiguousarray(place[:, k])) for k in range(3)]], names=["gnum", "down", "cell", "s", "x", "y", "z"])

    hit = met.mapInArrow(run, "gnum long, down boolean, cell long, s double, x double, y double, z double").select("gnum", "down", F.struct("cell", "s", "x", "y", "z").alias("m"))
    none = rays.select("gnum", "down", F.lit(None).cast(hit.schema["m"].dataType).alias("m"))  # nulls don't count
    first = hit.unionByName(none).groupBy("gnum", "down").agg(F.min("m").alias("m"))
    return first.select("gnum", F.when(F.col("down"), "down").otherwise("up").alias("way"), "m.cell", "m.x", "m.y", "m.z")


def entered(batch: pa.RecordBatch, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (.., v, dx, dy, dz, vtx, p, t from the fourth column on): those whose ray from v along d leaves the cell through
    a triangle without v, how many lengths of d away, the nearest such place, and that place."""
    flat = lambda k: pc.list_flatten(batch.column(k)).to_numpy(zero_copy_only=False)
    size = lambda k: pc.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64)
    v, d = batch.column(3).to_numpy(), np.stack([batch.column(k).to_numpy() for k in (4, 5, 6)], axis=1)
    ids, points, n = flat(7), flat(8).reshape(-1, 3), size(7)
    begin = np.cumsum(n) - n
    whose = np.repeat(np.arange(len(n)), size(9) // 3)
    t = flat(9).reshape(-1, 3) + begin[whose, None]
    away = (ids[t] != v[whose, None]).all(axis=1)
    whose, t = whose[away], t[away]
    at = np.flatnonzero(ids == np.repeat(v, n))  # a ray begins at a corner of its cell
    o = np.empty((len(n), 3))
    o[np.repeat(np.arange(len(n)), n)[at]] = points[at]
    found, s = hits(o[whose], d[whose], points[t], slack)
    row, s = whose[found], s[found]
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
    row, s = row[first], s[first]
    return row, s, o[row] + s[:, None] * d[row]
