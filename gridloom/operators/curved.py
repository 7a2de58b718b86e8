"""Location of points in general and curved elements, with reference coordinates and weights.

An element's box, widened by what its shape functions can reach beyond its nodes, meets points in the box join. For each
pair Newton's method looks for the reference coordinates: a bounded number of steps from the middle, all pairs of a batch
and type at once, with a flag for those that settled. A point belongs to the element whose reference coordinates hold it,
to the one with the smaller number where several do (on shared faces); neighbours share the nodes of a face, planar or
not, so there are no gaps and no overlaps between them.

Defined results: points in no element come back with nulls; a pair whose steps don't settle, or meet a singular Jacobian, counts as
outside; elements with unknown vertices hold nothing; null coordinates are in no element; repeated points are rows of
their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import shapes
from gridloom.functions.tables import materialise
from gridloom.operators.elements import by_type, with_points
from gridloom.operators.spatial import XYZ, points_in_boxes

STEPS, SETTLED = 40, 1e-13


def newton(shape: shapes.Shape, nodes: np.ndarray, p: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Reference coordinates (count, 3) of points (count, 3) in elements (count, nodes, 3), and whether they settled."""
    x = np.broadcast_to(shape.nodes.mean(axis=0), p.shape).copy()
    settled, lost = np.zeros(len(p), bool), np.zeros(len(p), bool)
    for _ in range(steps):
        at = np.flatnonzero(~settled & ~lost)
        if not len(at):
            break
        value, slope = shape.values(x[at])
        gap = p[at] - np.einsum("kn,knc->kc", value, nodes[at])
        jacobian = np.einsum("kna,knc->kca", slope, nodes[at])
        det = np.linalg.det(jacobian)
        size = np.abs(jacobian).max(axis=(1, 2), initial=0)
        fine = np.abs(det) > 1e-14 * size**3
        lost[at[~fine]] = True
        at, gap, jacobian = at[fine], gap[fine], jacobian[fine]
        move = np.linalg.solve(jacobian, gap[:, :, None])[:, :, 0]
        far = np.abs(move).max(axis=1, initial=0)
        x[at] += move * np.minimum(1, 1 / np.maximum(far, 1e-300))[:, None]  # no step beyond the element's own size
        settled[at] = far <= SETTLED * 100
        lost[at] |= ~np.isfinite(x[at]).all(axis=1) | (np.abs(x[at]).max(axis=1, initial=0) > 20)
    return x, settled


def locate(points: DataFrame, elements: DataFrame, vertices: DataFrame, order: int = 1, ordering: str = "vtk", tolerance: float = 1e-9) -> DataFrame:
    """points: (gnum, x, y, z); elements: (gnum, elt_type, vtx) of volumes, nodes in the ordering's order; vertices: (gnum, x,
    y, z). (gnum, elt, uvw, vtx, weights): the containing element, the reference coordinates, its nodes and their weights;
    nulls for points in none."""
    kinds = [k for k, d in shapes.DIMENSION.items() if d == 3 and (order == 1 or k != "pyramid")]
    known = {}
    for kind in kinds:
        try:
            known[kind] = shapes.shape(kind, order, ordering)
        except ValueError:
            continue
    count = by_type({k: F.lit(len(s.nodes)) for k, s in known.items()})
    held = with_points(elements, vertices).where((F.size("p") == count) & (F.size("vtx") == count))
    reach = by_type({k: F.lit((s.reach - 1) / 2 + 1e-9) for k, s in known.items()})
    low, high = ([f(F.col("p").getField(k)) for k in XYZ] for f in (F.array_min, F.array_max))
    ends = [e.alias(f"{k}{n}") for k, a, b in zip(XYZ, low, high, strict=True) for e, n in ((a - (b - a) * reach, "min"), (b + (b - a) * reach, "max"))]
    boxes = materialise(held.select("gnum", "elt_type", "vtx", *[F.flatten(F.transform("p", lambda q: F.array(*[q[k] for k in XYZ]))).alias("nodes")], *ends))
    met = points_in_boxes(points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("gnum", *XYZ), boxes)

    def run(batches):
        for batch in batches:
            types = np.array(batch.column(1).to_pylist(), object)
            out = []
            for kind, shape in known.items():
                at = np.flatnonzero(types == kind)
                if not len(at):
                    continue
                rows = batch.take(pa.array(at))
                nodes = rows.column(2).flatten().to_numpy().reshape(len(at), -1, 3)
                p = np.stack([rows.column(k).to_numpy() for k in (3, 4, 5)], axis=1)
                x, settled = newton(shape, nodes, p)
                inside = np.flatnonzero(settled & shape.inside(x, tolerance))
                weights = shape.values(x[inside])[0]
                out += zip(rows.column(0).take(pa.array(inside)).to_pylist(), rows.column(6).take(pa.array(inside)).to_pylist(), x[inside].tolist(), weights.tolist(), strict=True)
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            vector = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), vector, vector), strict=True)], names=["elt", "gnum", "uvw", "weights"])

    found = met.select(F.col("b_gnum").cast("long"), "b_elt_type", "b_nodes", *[F.col(k).cast("double") for k in XYZ], F.col("gnum").cast("long")).mapInArrow(run, "elt long, gnum long, uvw array<double>, weights array<double>")
    first = found.groupBy("gnum").agg(F.min(F.struct("elt", "uvw", "weights")).alias("m")).select("gnum", "m.*")
    named = first.join(elements.select(F.col("gnum").alias("elt"), "vtx"), "elt")
    return points.select("gnum").join(named, "gnum", "left").select("gnum", "elt", "uvw", "vtx", "weights")


def interpolated(located: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(gnum, names): nodal fields (gnum, names) at the located points."""
    each = located.where("elt IS NOT NULL").select("gnum", F.explode(F.arrays_zip("vtx", "weights")).alias("x")).select("gnum", "x.*")
    met = each.join(values.withColumnRenamed("gnum", "vtx"), "vtx")
    return met.groupBy("gnum").agg(*[F.sum(F.col("weights") * F.col(n)).alias(n) for n in names])
