"""Mean value coordinates of points in polyhedra given by their faces.

Each triangle of the surface, seen from the point, covers a piece of the unit sphere; the integral of the directions over
that piece is a combination of those of its corners, whose factors over the corners' distances are the triangle's share
of their weights. Weights of a vertex add up over the triangles around it. Where the point lies on a triangle, or at a
vertex, that triangle's own coordinates, or the vertex alone, take the place of the sum.

Defined results: faces are triangles, or planar polygons that fan out from their smallest vertices; points outside have
coordinates too (some negative for shapes that aren't convex); triangles without area and triangles whose plane the point lies in, beside
them, have no share; a cell without faces gives no rows; null coordinates give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tables import materialise

#: Shares of a triangle's longest side: beside it, a point this near its plane has no part of it; within this, it lies on it.
NEAR, FLAT = 1e-9, 1e-12


def face_triangles(cell_face: DataFrame, faces: DataFrame) -> DataFrame:
    """(cell, v1, v2, v3), turned out of the cell; cell_face: (src, pos, dst), a positive dst walks its face so that the
    normal points out; faces: (face, vtx)."""
    at = F.array_position("vtx", F.array_min("vtx")).cast("int")
    ring = F.concat(F.slice("vtx", at, F.size("vtx")), F.slice("vtx", F.lit(1), at - 1))
    cut = faces.where("size(vtx) > 2").select("face", ring.alias("ring")).select("face", F.explode(F.transform(F.sequence(F.lit(1), F.size("ring") - 2), lambda k: F.struct(F.get("ring", F.lit(0)).alias("a"), F.get("ring", k).alias("b"), F.get("ring", k + 1).alias("c")))).alias("t"))
    used = cell_face.select(F.col("src").alias("cell"), F.abs("dst").alias("face"), (F.col("dst") > 0).alias("out")).join(cut, "face")
    return used.select("cell", F.col("t.a").alias("v1"), F.when(F.col("out"), F.col("t.b")).otherwise(F.col("t.c")).alias("v2"), F.when(F.col("out"), F.col("t.c")).otherwise(F.col("t.b")).alias("v3"))


def shares(p: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of points (count, 3) and triangles (count, 3 corners, 3): the kind (0 at a vertex, 1 on the triangle, 2 beside it, 3
    without a share) and the corners' shares (count, 3).

    The integral over the triangle's piece of the sphere is a sum over its sides, each the angle times half the normal of
    the side's plane through the point; both triangles of a side take the same numbers, so a closed surface's integrals add
    up to zero to the last digits. Shares solve three equations a triangle; elimination leaves a small remainder however flat
    the triangle is seen, and so linear functions come out to rounding."""
    after, before = [1, 2, 0], [2, 0, 1]
    dot = lambda x, y: (x * y).sum(axis=-1)
    size = np.sqrt(((corners - corners[:, after]) ** 2).sum(axis=2)).max(axis=1)
    offset = corners - p[:, None, :]
    d = np.sqrt((offset**2).sum(axis=2))
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    area = np.sqrt(dot(normal, normal))
    with np.errstate(all="ignore"):
        high = np.abs(dot(offset, normal[:, None, :])).min(axis=1) / area
        parts = np.cross(offset[:, after], offset[:, before])
        inside = (dot(parts, normal[:, None, :]) >= -FLAT * area[:, None] ** 2).all(axis=1)
        on = np.sqrt(dot(parts, parts))
        on /= on.sum(axis=1)[:, None]
        u = offset / d[:, :, None]
        c = np.cross(u[:, after], u[:, before])
        sine = np.sqrt(dot(c, c))
        angle = np.arctan2(sine, dot(u[:, after], u[:, before]))
        whole = (np.where(sine > 0, angle / np.where(sine > 0, sine, 1), 0)[:, :, None] * c).sum(axis=1) / 2
    kind = np.full(len(p), 2)
    kind[~(high > NEAR * size)] = 3
    near = (high <= NEAR * size) & inside
    kind[near & (high > FLAT * size)] = 2
    kind[near & (high <= FLAT * size)] = 1
    at = d <= FLAT * size[:, None]
    kind[at.any(axis=1) & (size > 0)] = 0
    beside = np.zeros_like(d)
    held = np.flatnonzero(kind == 2)
    beside[held] = np.linalg.solve(offset[held].transpose(0, 2, 1), whole[held][:, :, None])[:, :, 0]
    return kind, np.where((kind == 0)[:, None], at, np.where((kind == 1)[:, None], on, beside)).astype(np.float64)


def triangle_shares(df: DataFrame) -> DataFrame:
    """df: gnum, cell, v1, v2, v3 and the coordinates of the point and the corners, twelve doubles. (gnum, cell, v1, v2, v3,
    kind, w), but for triangles without a share."""

    def run(batches):
        for batch in batches:
            xyz = np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5, 17)]).T.reshape(-1, 4, 3)
            kind, w = shares(xyz[:, 0], xyz[:, 1:])
            held = np.flatnonzero(kind < 3)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(held)) for k in range(5)], pa.array(kind[held].astype(np.int32)), pa.array(list(w[held]), pa.list_(pa.float64()))], names=["gnum", "cell", "v1", "v2", "v3", "kind", "w"])

    return df.mapInArrow(run, "gnum long, cell long, v1 long, v2 long, v3 long, kind int, w array<double>")


def mean_value_weights(pairs: DataFrame, triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """pairs: (gnum, cell, x, y, z), points and the polyhedra that they are wanted in; triangles: as of face_triangles;
    vertices: (gnum, x, y, z). (gnum, cell, v, weight): weights of a pair add up to 1."""
    t = triangles.select(*[F.col(c).cast("long") for c in ("cell", "v1", "v2", "v3")])
    for k in "123":
        t = t.join(vertices.select(F.col("gnum").alias(f"v{k}"), *[F.col(a).cast("double").alias(f"{a}{k}") for a in "xyz"]), f"v{k}")
    points = pairs.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(F.col("gnum").cast("long"), F.col("cell").cast("long"), *[F.col(a).cast("double") for a in "xyz"])
    found = materialise(triangle_shares(points.join(t, "cell").select("gnum", "cell", "v1", "v2", "v3", *[f"{a}{k}" for k in ("", 1, 2, 3) for a in "xyz"])))
    kinds = found.groupBy("gnum", "cell").agg(F.min("kind").alias("kind"))
    each = found.join(kinds, ["gnum", "cell", "kind"]).select("gnum", "cell", F.explode(F.arrays_zip(F.array("v1", "v2", "v3").alias("v"), F.col("w"))).alias("x"))
    sums = materialise(each.groupBy("gnum", "cell", F.col("x.v").alias("v")).agg(F.sum("x.w").alias("w")))
    total = sums.groupBy("gnum", "cell").agg(F.sum("w").alias("total"))
    return sums.join(total, ["gnum", "cell"]).where("total <> 0").select("gnum", "cell", "v", (F.col("w") / F.col("total")).alias("weight"))


def interpolated(weights: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(gnum, cell, names): the weighted means of values (gnum, names) at the vertices."""
    met = weights.join(values.withColumnRenamed("gnum", "v"), "v")
    return met.groupBy("gnum", "cell").agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])
