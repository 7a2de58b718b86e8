"""The common refinement of two planar meshes of simple polygons, with one numbering of its points."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exact import BOUNDS, UNIT
from gridloom.functions.predicates import in_polygon
from gridloom.functions.tables import materialise, numbered
from gridloom.operators.contours import ordered_loops
from gridloom.operators.elements import with_points
from gridloom.operators.ids import from_keys
from gridloom.operators.spatial import meet_in_blocks, points_in_boxes, rows_of


def ring_sides(mesh: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(edge, v, w, px, py, qx, qy), one for each two vertices that some ring joins, v < w; and (face, edge, ahead): the
    rings' sides, ahead where they go from v to w."""
    rings, vertices = mesh
    after = F.concat(F.slice("vtx", F.lit(2), F.size("vtx") - 1), F.slice("vtx", 1, 1))
    walk = rings.select(F.col("gnum").alias("face"), F.explode(F.arrays_zip(F.col("vtx").alias("v"), after.alias("w"))).alias("s")).select("face", "s.v", "s.w")
    named = materialise(from_keys(walk.select("face", F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w"), (F.col("v") < F.col("w")).alias("ahead")), ["v", "w"], "edge"))
    at = lambda k, p: vertices.select(F.col("gnum").alias(k), F.col("x").cast("double").alias(f"{p}x"), F.col("y").cast("double").alias(f"{p}y"))
    edges = named.select("edge", "v", "w").distinct().join(at("v", "p"), "v").join(at("w", "q"), "w")
    return materialise(edges), named.select("face", "edge", "ahead")


def turns(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """1 where a, b, c turn left, -1 where they turn right, 0 on one line: exact signs, as exact.orient2d_sign gives."""
    x0, y0, x1, y1 = a[:, 0] - c[:, 0], a[:, 1] - c[:, 1], b[:, 0] - c[:, 0], b[:, 1] - c[:, 1]
    left, right = x0 * y1, y0 * x1
    out, (k, m) = np.sign(left - right), BOUNDS["orient2d"]
    unsure = ~(np.abs(left - right) > (np.abs(left) + np.abs(right)) * ((k + m * UNIT) * UNIT)) & ((left != 0) | (right != 0))
    for n in np.flatnonzero(unsure):
        if not all(np.isfinite([*a[n], *b[n], *c[n]])):
            continue
        (ax, ay), (bx, by), (cx, cy) = ([Fraction(float(v)) for v in p[n]] for p in (a, b, c))
        d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        out[n] = (d > 0) - (d < 0)
    return np.where(np.isfinite(a).all(1) & np.isfinite(b).all(1) & np.isfinite(c).all(1), out, 0)


def with_faces(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """edges with f_left and f_right, the rings on either side of an edge from p to q; null on both sides of one that doesn't
    border two rings, one a side."""
    ahead = lambda c: F.max(F.when(c, F.col("face")))
    beside = sides.groupBy("edge").agg(F.count("*").alias("n"), ahead(F.col("ahead")).alias("f_left"), ahead(~F.col("ahead")).alias("f_right"))
    return edges.join(beside.where("n = 2 AND f_left IS NOT NULL AND f_right IS NOT NULL").drop("n"), "edge", "left")


def edge_crossings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_edge, b_edge, t, u, x, y, and a_before, a_after, b_before, b_after) where edges cross within both, by exact signs; t
    and u: the places along them; a_before, a_after: the rings of b that a's edge leaves and enters there, null if b's edge
    doesn't tell; b_before, b_after: those of a. left, right: as of with_faces."""

    def crossing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        ends = lambda a, b: (a[:, :2], a[:, 2:4], b[:, :2], b[:, 2:4])
        ap, aq, bp, bq = ends(a, b)
        keep = np.flatnonzero(turns(ap, aq, bp) * turns(ap, aq, bq) < 0)
        ap, aq, bp, bq = ends(a[keep], b[keep])
        goes = turns(bp, bq, aq)  # 1 where a goes to the left of b, and so b to the right of a
        fine = turns(bp, bq, ap) * goes < 0
        keep, goes = keep[fine], goes[fine]
        ap, aq, bp, bq = ends(a[keep], b[keep])
        d, e, w = aq - ap, bq - bp, bp - ap
        det = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        det = np.where(det != 0, det, np.nan)
        t, u = ((w[:, 0] * f[:, 1] - w[:, 1] * f[:, 0]) / det for f in (e, d))
        at = {k: ap[:, n] * (1 - t) + aq[:, n] * t for n, k in enumerate("xy")}
        (al, ar), (bl, br) = (f[keep, 4:6].T for f in (a, b))
        up = goes > 0
        faces = {"a_before": np.where(up, br, bl), "a_after": np.where(up, bl, br), "b_before": np.where(up, al, ar), "b_after": np.where(up, ar, al)}
        return keep, {"t": t, "u": u} | at | faces

    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    data = F.array(*[F.col(c) for c in ("px", "py", "qx", "qy")], known("f_left"), known("f_right")).alias("data")
    ends = [f(f"p{k}", f"q{k}").alias(f"{k}{n}") for k in "xy" for f, n in ((F.least, "min"), (F.greatest, "max"))]
    faces = ["a_before", "a_after", "b_before", "b_after"]
    met = meet_in_blocks(*[d.select(F.col("edge").alias("gnum"), data, *ends) for d in (left, right)], crossing, ["t", "u", "x", "y", *faces], axes=["x", "y"])
    real = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("t", "u", "x", "y")]
    return met.select(F.col("a_gnum").alias("a_edge"), F.col("b_gnum").alias("b_edge"), *real, *[F.when(F.col(c) != 0, F.col(c).cast("long")).alias(c) for c in faces])


def pieces_of_edges(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(edge, low, high, x, y, other): the stretches of each edge between its nodes, with their middles and the ring of the
    other mesh that holds them, null where the nodes don't tell; cuts: (edge, t, node, x, y, before, after), the ends' nodes at
    t = 0 and 1 included.

    A range sort lays the cuts out along the edges; each one meets the next as the rows pass, and the last one of a
    partition the first one of those that follow."""
    fields = ["edge", "node", "x", "y", "before", "after"]
    kinds = "long", "long", "double", "double", "long", "long"
    flat = cuts.repartitionByRange("edge", "t", "node").sortWithinPartitions("edge", "t", "node").select(*[F.col(c).cast(k) for c, k in zip(fields, kinds, strict=True)], F.spark_partition_id().alias("part"))
    after = ["edge", "node", "x", "y", "before"]
    schema = ", ".join([*[f"{c} {k}" for c, k in zip(fields, kinds, strict=True)], "part int", *[f"n_{c} {kinds[fields.index(c)]}" for c in after]])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the next one; a partition's first row comes again as the next one of none."""
        held, names = None, [*fields, "part", *[f"n_{c}" for c in after]]
        for batch in batches:
            if not batch.num_rows:
                continue
            row = pa.Table.from_batches([batch])
            if held is None:
                none = pa.table([*[pa.nulls(1, row.schema.field(c).type) for c in fields], row.column("part").slice(0, 1), *[row.column(c).slice(0, 1) for c in after]], names=names)
                yield from none.combine_chunks().to_batches()
                held = row.slice(0, 0)
            row = pa.concat_tables([held, row]).combine_chunks()
            held, n = row.slice(row.num_rows - 1), row.num_rows - 1
            yield from pa.table([*[row.column(c).slice(0, n) for c in (*fields, "part")], *[row.column(c).slice(1) for c in after]], names=names).combine_chunks().to_batches()
        if held is not None:
            yield from pa.table([*[held.column(c) for c in (*fields, "part")], *[pa.nulls(1, held.schema.field(c).type) for c in after]], names=names).combine_chunks().to_batches()

    met = materialise(flat.mapInArrow(follow, schema))
    nexts = [f"n_{c}" for c in after]
    heads, tails = met.where("edge IS NULL").select("part", *nexts), met.where("n_edge IS NULL").drop(*nexts)
    ahead = tails.select(F.col("part").alias("_p")).join(F.broadcast(heads.select(F.col("part").alias("_q"))), F.col("_q") > F.col("_p")).groupBy("_p").agg(F.min("_q").alias("_q"))  # a row a partition
    over = tails.join(F.broadcast(ahead), F.col("part") == F.col("_p")).join(F.broadcast(heads.withColumnRenamed("part", "_h")), F.col("_q") == F.col("_h"))
    pairs = met.where("edge = n_edge").select(*fields, *nexts).unionByName(over.where("edge = n_edge").select(*fields, *nexts))
    middle = [((F.col(k) + F.col(f"n_{k}")) / 2).alias(k) for k in "xy"]
    return pairs.select("edge", F.col("node").alias("low"), F.col("n_node").alias("high"), *middle, F.coalesce("after", "n_before").alias("other"))


def containing(stretches: DataFrame, mesh: tuple[DataFrame, DataFrame]) -> DataFrame:
    """stretches with other, the ring of a mesh that holds the middle of each, looked for where it is null; those in none go."""
    named = materialise(stretches.where("other IS NULL").drop("other").withColumn("gnum", F.monotonically_increasing_id()))
    e = with_points(mesh[0].select("gnum", "vtx"), mesh[1].withColumn("z", F.lit(0.0)))
    ends = [f(F.col("p").getField(k)).alias(f"{k}{n}") for k in "xy" for f, n in ((F.array_min, "min"), (F.array_max, "max"))]
    met = points_in_boxes(named.select("gnum", "x", "y"), materialise(e.select("gnum", "p", *ends)), ["x", "y"])
    inside = met.where(in_polygon(F.struct("x", "y"), F.col("b_p"))).groupBy("gnum").agg(F.min("b_gnum").alias("other"))
    return stretches.where("other IS NOT NULL").unionByName(named.join(inside, "gnum").drop("gnum"))


def overlay_meshes(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
    """The common refinement of two planar meshes (rings (gnum, vtx) that turn left, vertices (gnum, x, y)) of simple
    polygons, convex or not, in one numbering.

    points: (gnum, x, y, a_vtx, b_vtx, a_edge, b_edge): the vertices of a, those of b, and one point for each two edges that
    cross. pieces: (gnum, a, b, area): a closed ring of the part that two polygons share; several where they share several,
    a hole's with a negative area. piece_points: (src, pos, dst).

    Edges are cut at their crossings; each stretch lies in one polygon of the other mesh: one beside the edge that it crosses
    at an end, where that edge has a polygon on either side; else its middle tells. A piece's
    border is what borders a within b and what borders b within a; at each of its points one stretch comes and one goes,
    so the stretches link up into rings. Meshes must be in general position: no vertex of one on an edge or vertex of the
    other; of edges that only touch, nothing is cut."""
    edges, sides = zip(ring_sides(left), ring_sides(right), strict=True)
    n_left = left[1].agg(F.max("gnum")).first()[0] or 0
    n_right = right[1].agg(F.max("gnum")).first()[0] or 0
    first = n_left + n_right
    crossings = edge_crossings(*[with_faces(e, s) for e, s in zip(edges, sides, strict=True)])
    met = materialise(numbered(crossings, ["a_edge", "b_edge"], "k").withColumn("node", F.col("k") + first))
    links, none = None, F.lit(None).cast("long")
    for own, other, edge, place, shift in ((0, 1, "a_edge", "t", 0), (1, 0, "b_edge", "u", n_left)):
        tips = [edges[own].select("edge", F.lit(at).alias("t"), (F.col(c) + shift).alias("node"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"), none.alias("before"), none.alias("after")) for at, c, p in ((0.0, "v", "p"), (1.0, "w", "q"))]
        faces = [F.col(f"{'ab'[own]}_{c}").alias(c) for c in ("before", "after")]
        cuts = tips[0].unionByName(tips[1]).unionByName(met.select(F.col(edge).alias("edge"), F.col(place).alias("t"), "node", "x", "y", *faces))
        found = containing(pieces_of_edges(edges[own], cuts), (left, right)[other]).join(sides[own], "edge")
        way = found.select(F.col("face").alias("ab"[own]), F.col("other").alias("ab"[other]), F.when(F.col("ahead"), F.col("low")).otherwise(F.col("high")).alias("start"), F.when(F.col("ahead"), F.col("high")).otherwise(F.col("low")).alias("stop"))
        links = way if links is None else links.unionByName(way)
    rings = materialise(ordered_loops(materialise(links.select("a", "b", "start", "stop")), ["a", "b"]))
    points = left[1].select("gnum", "x", "y", F.col("gnum").alias("a_vtx"), none.alias("b_vtx"), none.alias("a_edge"), none.alias("b_edge"))
    points = points.unionByName(right[1].select((F.col("gnum") + n_left).alias("gnum"), "x", "y", none.alias("a_vtx"), F.col("gnum").alias("b_vtx"), none.alias("a_edge"), none.alias("b_edge")))
    points = points.unionByName(met.select(F.col("node").alias("gnum"), "x", "y", none.alias("a_vtx"), none.alias("b_vtx"), "a_edge", "b_edge"))
    at = rings.select("a", "b", "loop", "pos", F.col("point").alias("v")).join(points.select(F.col("gnum").alias("v"), "x", "y"), "v")
    ring = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))  # a piece's own corners
    shoelace = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda acc, i: acc + F.get(r, i)["x"] * F.get(r, (i + 1) % F.size(r))["y"] - F.get(r, i)["y"] * F.get(r, (i + 1) % F.size(r))["x"]) / 2
    areas = at.groupBy("a", "b", "loop").agg(ring.alias("ring")).select("a", "b", "loop", shoelace(F.col("ring")).alias("area"))
    pieces = numbered(areas, ["a", "b", "loop"])
    named = rings.join(pieces.select("gnum", "a", "b", "loop"), ["a", "b", "loop"])
    return {"points": points, "pieces": pieces.select("gnum", "a", "b", "area"), "piece_points": named.select(F.col("gnum").alias("src"), "pos", F.col("point").alias("dst"))}


#: Rings of one side in a block of shared_areas; most pairs of two meshes' rings in one place share something.
FEW = 1024


def shared_areas(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(a, b, area): the pieces of overlay_meshes, without its numbering. What two convex rings share is one piece, which is cut
    out where the rings meet, in blocks, so that only rings are shuffled; whether they share any is told by exact signs. Pieces
    of rings that aren't convex come from the overlay."""
    sides, odd = zip(*[shaped(*mesh) for mesh in (left, right)], strict=True)
    found = meet_in_blocks(*sides, shared, ["area"], (with_ends, with_ends), ["x", "y"], FEW)
    found = found.select(F.col("a_gnum").alias("a"), F.col("b_gnum").alias("b"), "area")
    if not odd[0].unionByName(odd[1]).limit(1).count():
        return found
    every = overlay_meshes(left, right)["pieces"].select("a", "b", "area")
    for own, d in zip("ab", odd, strict=True):
        every = every.join(d.select(F.col("gnum").alias(own), F.lit(True).alias(f"_{own}")), own, "left")
    return found.unionByName(every.where("_a OR _b").select("a", "b", "area"))


def shaped(rings: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The convex rings with their boxes and, as data, the number of corners and the corners, two numbers each; and (gnum) of
    the others."""
    at = with_points(rings.select("gnum", "vtx"), vertices.withColumn("z", F.lit(0.0))).where("size(p) > 2")
    flat = F.concat(F.array(F.size("p").cast("double")), F.flatten(F.transform("p", lambda q: F.array(q["x"].cast("double"), q["y"].cast("double")))))
    ends = [f(F.col("p").getField(k)).cast("double").alias(f"{k}{n}") for k in "xy" for f, n in ((F.array_min, "min"), (F.array_max, "max"))]
    names = [f"{k}{n}" for k in "xy" for n in ("min", "max")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, row = with_ends(rows_of(batch.column(1))), np.arange(batch.num_rows)
                n, p = data[:, :1], data[:, 1:].reshape(len(data), -1, 2)
                after, before = next_of(n, p.shape[1])
                turn = np.stack([turns(p[row, before[:, k]], p[:, k], p[row, after[:, k]]) for k in range(p.shape[1])], axis=1)
                # corners of simple polygons that all turn left go around once
                yield batch.append_column("convex", pa.array(((turn >= 0) | (np.arange(p.shape[1]) >= n)).all(axis=1)))

    kinds = f"gnum long, data array<double>, {', '.join(f'{c} double' for c in names)}"
    told = materialise(at.select(F.col("gnum").cast("long"), flat.alias("data"), *ends).mapInArrow(run, f"{kinds}, convex boolean"))
    return told.where("convex").drop("convex"), told.where("NOT convex").select("gnum")


def with_ends(data: np.ndarray) -> np.ndarray:
    """Rings as of `shaped`, filled up with zeros, as rows whose last corners are as the first one beyond their number."""
    p = data[:, 1:].reshape(len(data), -1, 2)
    full = np.where((np.arange(p.shape[1])[None, :] < data[:, :1])[:, :, None], p, p[:, :1])
    return np.concatenate([data[:, :1], full.reshape(len(data), -1)], axis=1)


def next_of(n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places after and before each of `width` places of rings of n (count, 1) corners."""
    k, n = np.arange(width)[None, :], n.astype(int)
    return np.where(k + 1 < n, k + 1, 0), np.where(k > 0, k - 1, n - 1)


def shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of pairs of convex rings as of with_ends: those that share more than a border, and the area that they share."""
    n, m = a[:, :1], b[:, :1]
    a, b = a[:, 1:].reshape(len(a), -1, 2), b[:, 1:].reshape(len(b), -1, 2)
    keep = np.flatnonzero(~(apart(a, n, b) | apart(b, m, a)))
    p, size = a[keep], n[keep, 0].astype(int)
    for k in range(b.shape[1]):
        q, on = b[keep], k < m[keep, 0]
        at, to = q[:, k], q[np.arange(len(q)), next_of(m[keep], b.shape[1])[0][:, k]]
        p, size = cut_left(p, size, at, np.where(on[:, None], to, at))
    after = next_of(size[:, None], p.shape[1])[0]
    d = p - p[:, :1]
    e = np.take_along_axis(d, after[:, :, None], 1)
    cross = np.where(np.arange(p.shape[1])[None, :] < size[:, None], d[:, :, 0] * e[:, :, 1] - d[:, :, 1] * e[:, :, 0], 0.0)
    return keep, {"area": cross.sum(axis=1) / 2}


def apart(a: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where some side of convex rings a, of n corners, has none of the corners of b on its left, by exact signs."""
    out, row = np.zeros(len(a), bool), np.arange(len(a))
    after = next_of(n, a.shape[1])[0]
    for k in range(a.shape[1]):
        right = k < n[:, 0]
        for j in range(b.shape[1]):
            right = right & ~out
            left = np.flatnonzero(right)
            right[left] = turns(a[left, k], a[row, after[:, k]][left], b[left, j]) <= 0
        out |= right
    return out


def cut_left(p: np.ndarray, size: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of convex rings p, of `size` corners, lies to the left of the lines from `at` to `to`, and how many corners that has;
    all of it where `at` is `to`."""
    if not len(p):
        return p, size
    width, e = p.shape[1], to - at
    before = next_of(size[:, None], width)[1]
    s = e[:, :1] * (p[:, :, 1] - at[:, 1:]) - e[:, 1:] * (p[:, :, 0] - at[:, :1])
    q, t = np.take_along_axis(p, before[:, :, None], 1), np.take_along_axis(s, before, 1)
    held = np.arange(width)[None, :] < size[:, None]
    over = held & ((t < 0) != (s < 0))
    u = t / np.where(over, t - s, 1.0)
    new = q + u[:, :, None] * (p - q)
    # a level or upright line has its own height or place
    new = np.where(((e == 0) & (e != 0).any(axis=1, keepdims=True))[:, None, :], at[:, None, :], new)
    both = np.stack([new, p], axis=2).reshape(len(p), -1, 2)
    kept = np.stack([over, held & (s >= 0)], axis=2).reshape(len(p), -1)
    size = kept.sum(axis=1)
    order = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, int(size.max()))]
    return np.take_along_axis(both, order[:, :, None], 1), size
