"""Iso-lines of polygons and iso-surfaces of polyhedra given by their faces.

A vertex is up if its value exceeds the level. Along a face's ring, crossed edges alternate between those that go up and
those that come down; the line on the face runs from each edge that goes up to the next one, which comes down, so it cuts
off a run of vertices that are up. A cell walks each of its crossed edges in two faces, once each way, so the ends of its
lines meet in pairs: the lines form closed loops, each one a polygon of the surface. Loops are found and put in order in
buckets of whole cells, and by pointer jumping over all rows at once in cells too large for that. The line of a shared face
is the same from both cells, walked the other way, so the surface is closed and oriented: its normals point from up to
down where faces point out of their cells.

Defined results: a vertex on the level counts as below; cells and faces without a crossed edge have no rows; several
loops of a cell are several polygons; an empty mesh gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tables import materialise, numbered


def crossed(face_vtx: DataFrame, vertices: DataFrame, level: float) -> DataFrame:
    """(face, cut): the edges of each ring that the level crosses, in order, as an array<struct v1, v2, rises, t>, of the rings
    that have any; v1 < v2, t is the weight of v2. face_vtx: (src, pos, dst)."""
    at = face_vtx.select(F.col("src").alias("face"), "pos", F.abs("dst").alias("v")).join(vertices.select(F.col("gnum").alias("v"), F.col("value").alias("a")), "v", "left")
    ring = at.groupBy("face").agg(F.array_sort(F.collect_list(F.struct("pos", "v", "a"))).alias("ring"))  # a face's own corners
    # an edge of a vertex without a value crosses nothing
    side = lambda p, q: (p["a"] > level) != (q["a"] > level)
    pair = lambda p, i: F.struct(p.alias("p"), F.get("ring", (i + 1) % F.size("ring")).alias("q"))
    edges = F.filter(F.transform("ring", pair), lambda e: F.coalesce(side(e["p"], e["q"]), F.lit(False)))

    def named(e: Column) -> Column:
        p, q = e["p"], e["q"]
        t = (F.lit(level) - p["a"]) / (q["a"] - p["a"])
        return F.struct(F.least(p["v"], q["v"]).alias("v1"), F.greatest(p["v"], q["v"]).alias("v2"), (q["a"] > level).alias("rises"), F.when(p["v"] < q["v"], t).otherwise(1 - t).alias("t"))

    return ring.select("face", F.transform(edges, named).alias("cut")).where(F.size("cut") > 0)


def iso_lines(face_vtx: DataFrame, vertices: DataFrame, level: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Points (gnum, v1, v2, t, x, y, z), one a crossed edge, with its ends and the weight of the second; and lines (face,
    start, stop) on the faces, with what is up on their right, seen from where the face turns left."""
    cuts = materialise(crossed(face_vtx, vertices, level))
    each = cuts.select(F.explode("cut").alias("c")).groupBy("c.v1", "c.v2").agg(F.min("c.t").alias("t"))
    named = materialise(numbered(each, ["v1", "v2"]))
    points = named
    for k in "12":
        points = points.join(vertices.select(F.col("gnum").alias(f"v{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"]), f"v{k}")
    points = points.select("gnum", "v1", "v2", "t", *[(F.col(f"{a}1") * (1 - F.col("t")) + F.col(f"{a}2") * F.col("t")).alias(a) for a in "xyz"])
    ends = F.transform("cut", lambda c, i: F.struct(c.alias("c"), F.get("cut", (i + 1) % F.size("cut")).alias("d")))
    lines = cuts.select("face", F.explode(F.filter(ends, lambda e: e["c"]["rises"] & ~e["d"]["rises"])).alias("e"))
    lines = lines.select("face", *[F.col(f"e.{c}.v{k}").alias(f"{n}{k}") for c, n in (("c", "start"), ("d", "stop")) for k in "12"])
    for n in ("start", "stop"):
        lines = lines.join(named.select(F.col("v1").alias(f"{n}1"), F.col("v2").alias(f"{n}2"), F.col("gnum").alias(n)), [f"{n}1", f"{n}2"]).drop(f"{n}1", f"{n}2")
    return points, lines.select("face", "start", "stop")


#: Links of a bucket of cells, and of a cell that goes into one.
LINKS, MANY = 1 << 15, 1 << 18


def ordered_loops(links: DataFrame, keys: Sequence[str] = ("cell",), most: int = 60) -> DataFrame:
    """links: (cell, start, stop), a permutation within each cell, and any further columns; a cell may have several keys.
    (cell, loop, pos, point, further columns): the points of each loop in order from its smallest one, which names it.

    The links move once, to buckets of whole cells, where numpy jumps along all loops at once. Cells with more than `MANY`
    links never meet in one task: their loops are found by jumps of the whole frame."""
    further = [c for c in links.columns if c not in (*keys, "start", "stop")]
    kinds = {f.name: f.dataType for f in links.schema.fields}
    many = links.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = many.agg(F.sum("_n"), F.max("_n")).first()
    buckets = F.pmod(F.xxhash64(*keys), F.lit(max(1, (total[0] or 0) // LINKS)).cast("long")).alias("_bucket")
    whole, rest = links, None
    if (total[1] or 0) > MANY:
        many = materialise(many.where(F.col("_n") > MANY).select(*keys))
        whole, rest = links.join(many, list(keys), "left_anti"), jumped(links.join(many, list(keys), "left_semi"), keys, most)
    schema = ", ".join([*[f"{k} {kinds[k].simpleString()}" for k in keys], "loop long", "pos long", "point long", *[f"{c} {kinds[c].simpleString()}" for c in further]])

    def run(t: pa.Table) -> pa.Table:
        cell = np.zeros(t.num_rows, np.int64)
        for k in keys:
            own = np.unique(t.column(k).to_numpy(), return_inverse=True)[1]
            cell = np.unique(cell * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
        ends = [t.column(c).to_numpy() for c in ("start", "stop")]
        points = np.unique(np.concatenate(ends))
        named, wanted = (cell * len(points) + np.searchsorted(points, e) for e in ends)
        order = np.argsort(named, kind="stable")
        while not (closed := np.isin(named[order], wanted[order]) & np.isin(wanted[order], named[order])).all():
            order = order[closed]  # what leads nowhere is in no loop
        named, wanted = named[order], wanted[order]
        if len(np.unique(named)) < len(named):
            raise RuntimeError("links branch")
        hop = np.searchsorted(named, wanted)
        low, loop, far = np.arange(len(hop)), None, hop  # points of a cell lie in their order
        while loop is None or (low != loop).any():
            loop = low
            low, far = np.minimum(loop, loop[far]), far[far]
        root = low == np.arange(len(hop))
        far, d = np.where(root, low, hop), (~root).astype(np.int64)
        while (far != low).any():
            d, far = d + d[far], far[far]
        n = np.bincount(low, minlength=len(hop))[low]
        out = t.take(pa.array(order))
        point = out.column("start").cast(pa.int64())
        return pa.table([*[out.column(k) for k in keys], point.take(pa.array(low)), pa.array((n - d) % n), point, *[out.column(c) for c in further]], names=[*keys, "loop", "pos", "point", *further])

    out = whole.withColumn("_bucket", buckets).groupBy("_bucket").applyInArrow(run, schema)
    return out if rest is None else out.unionByName(rest)


def jumped(links: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """As of ordered_loops, by pointer jumping of all rows at once, in as many rounds as the logarithm of the longest loop."""
    cell = list(keys)
    further = [c for c in links.columns if c not in (*cell, "start", "stop")]
    links = materialise(links)
    now = materialise(links.select(*cell, F.col("start").alias("p"), F.col("stop").alias("hop"), F.col("start").alias("low")))
    for _ in range(most):
        far = now.select(*cell, F.col("p").alias("hop"), F.col("hop").alias("next"), F.col("low").alias("other"))
        step = materialise(now.join(far, [*cell, "hop"]).select(*cell, "p", F.col("next").alias("hop"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("new")))
        now = step.drop("new")
        if not step.where("new").limit(1).count():
            break
    else:
        raise RuntimeError("loops did not settle")
    loops = now.select(*cell, "p", "low")
    at = links.select(*cell, F.col("start").alias("p"), F.col("stop").alias("hop")).join(loops, [*cell, "p"])
    root = F.col("p") == F.col("low")
    left = materialise(at.select(*cell, "p", "low", F.when(root, F.col("p")).otherwise(F.col("hop")).alias("hop"), F.when(root, 0).otherwise(1).cast("long").alias("d")))
    for _ in range(most):
        if not left.where("hop <> low").limit(1).count():
            break
        far = left.select(*cell, F.col("p").alias("hop"), F.col("hop").alias("next"), F.col("d").alias("more"))
        left = materialise(left.join(far, [*cell, "hop"]).select(*cell, "p", "low", F.col("next").alias("hop"), (F.col("d") + F.col("more")).alias("d")))
    else:
        raise RuntimeError("ranks did not settle")
    n = left.groupBy(*cell, "low").agg(F.count("*").alias("n"))
    out = left.join(n, [*cell, "low"]).select(*cell, F.col("low").alias("loop"), F.pmod(F.col("n") - F.col("d"), F.col("n")).alias("pos"), F.col("p").alias("point"))
    return out.join(links.select(*cell, F.col("start").alias("point"), *further), [*cell, "point"]).select(*out.columns, *further) if further else out


def iso_surface(cell_face: DataFrame, face_vtx: DataFrame, vertices: DataFrame, level: float = 0.0) -> dict[str, DataFrame]:
    """cell_face: (src, pos, dst), a positive dst walks its face so that the normal points out of the cell; face_vtx: (src,
    pos, dst); vertices: (gnum, x, y, z, value).

    points: (gnum, v1, v2, t, x, y, z); lines: (face, start, stop), as of iso_lines; polygons: (gnum, cell), densely
    numbered by cell and smallest point; polygon_points: (src, pos, dst), pos from 0."""
    points, lines = iso_lines(face_vtx, vertices, level)
    lines = materialise(lines)
    used = cell_face.select(F.col("src").alias("cell"), F.abs("dst").alias("face"), (F.col("dst") > 0).alias("out")).join(lines, "face")
    links = materialise(used.select("cell", F.when(F.col("out"), F.col("start")).otherwise(F.col("stop")).alias("start"), F.when(F.col("out"), F.col("stop")).otherwise(F.col("start")).alias("stop")))
    loops = materialise(ordered_loops(links))
    polygons = materialise(numbered(loops.where("pos = 0").select("cell", "loop"), ["cell", "loop"]))
    points_of = loops.join(polygons, ["cell", "loop"]).select(F.col("gnum").alias("src"), "pos", F.col("point").alias("dst"))
    return {"points": points, "lines": lines, "polygons": polygons.select("gnum", "cell"), "polygon_points": points_of}
