"""Partitioning and renumbering of meshes and clouds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import sfc
from gridloom.functions.tables import Frames, absent, materialise, numbered, spread_join
from gridloom.operators.connectivity import lists, sign
from gridloom.operators.exchange import shared_graph
from gridloom.operators.ids import weighted_split

RENUMBERINGS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_renumbering(name: str, method: Callable[[DataFrame], DataFrame]) -> None:
    """A method takes a frame with part and gnum and adds the column lnum."""
    RENUMBERINGS[name] = method


def implicit_split(df: DataFrame, parts: int) -> DataFrame:
    """Contiguous chunks of gnum, the first ones a row larger; by each id's rank, not one window of all."""
    n = df.count()
    small, more = divmod(n, parts)
    k = F.col("_k") - 1
    part = F.when(k < more * (small + 1), F.floor(k / (small + 1))).otherwise(more + F.floor((k - more * (small + 1)) / max(small, 1)))
    return numbered(df, ["gnum"], "_k").withColumn("part", part.cast("int")).drop("_k")


def curve_split(df: DataFrame, parts: int, curve: str = "morton", axes: Sequence[str] = ("x", "y", "z"), weight: str | None = None, level: int = 15) -> DataFrame:
    """Chunks of a space-filling curve with nearly equal weight."""
    box = df.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]).first()
    cells = [sfc.grid(F.col(a), box[f"min_{a}"], box[f"max_{a}"], level) for a in axes]
    key = sfc.morton(cells, level) if curve == "morton" else sfc.hilbert(cells, level)
    w = F.col(weight) if weight else F.lit(1.0)
    return weighted_split(df.withColumn("_key", key).withColumn("_w", w), "_w", parts, ["_key", "gnum"], "part").drop("_key", "_w")


def assemble(df: DataFrame, order: Sequence[str] = ("gnum",)) -> DataFrame:
    """Local numbers from 1 within each part, however large."""
    return numbered(df, list(order), "lnum", ["part"]).withColumn("lnum", F.col("lnum").cast("int"))


def renumber_faces(df: DataFrame) -> DataFrame:
    """Faces (part, face, c1, c2) in the order of their larger and smaller cell."""
    hi, lo = F.greatest("c1", "c2"), F.least("c1", "c2")
    keyed = df.withColumn("_hi", hi).withColumn("_lo", lo)
    return assemble(keyed, ["_hi", "_lo", "face"]).drop("_hi", "_lo")


def renumber_random(df: DataFrame, seed: int = 0) -> DataFrame:
    return assemble(df.withColumn("_hash", F.xxhash64(F.lit(seed), "gnum")), ["_hash", "gnum"]).drop("_hash")


def renumber_cuthill(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Bandwidth-reducing order of each part's graph, breadth first from a vertex of least degree, reversed.

    df: (part, gnum); edges: (part, src, dst) within parts. All parts and all their connected pieces go on together, one
    level of neighbours a round (a join and a range sort), so neither a part nor a piece must fit one task. Pieces follow
    each other by their first vertices' degrees and ids; in a level, vertices go by the place of their first neighbour in
    the level before, by degree and by id.
    """
    e = edges.where("src <> dst").select("part", "src", "dst")
    near = materialise(e.unionByName(e.select("part", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = near.groupBy("part", F.col("src").alias("gnum")).agg(F.count("*").alias("degree"))
    nodes = df.select("part", "gnum").join(degree, ["part", "gnum"], "left").fillna(0, ["degree"])
    nodes = materialise(nodes.join(pieces_of(nodes.select("part", "gnum"), near), ["part", "gnum"]))
    first = nodes.groupBy("part", "piece").agg(F.min(F.struct("degree", "gnum")).alias("first"))
    front = materialise(first.select("part", "piece", F.col("first.gnum").alias("gnum"), F.lit(1).cast("long").alias("place"), F.lit(0).alias("level")))
    done = front
    for level in count(1):  # ends when no vertex is left to reach
        step = near.join(front.select("part", F.col("gnum").alias("src"), "place"), ["part", "src"]).groupBy("part", F.col("dst").alias("gnum")).agg(F.min("place").alias("before"))
        step = step.join(done.select("part", "gnum"), ["part", "gnum"], "left_anti").join(nodes, ["part", "gnum"])
        front = materialise(numbered(step, ["before", "degree", "gnum"], "place", ["part", "piece"]).select("part", "piece", "gnum", "place", F.lit(level).alias("level")))
        if not front.limit(1).count():
            break
        done = done.unionByName(front)
        if level % 20 == 0:
            done = materialise(done)
    starts = first.select("part", "piece", F.col("first.degree").alias("d0"), F.col("first.gnum").alias("g0"))
    order = numbered(done.withColumnRenamed("place", "at").join(starts, ["part", "piece"]), ["d0", "g0", "level", "at"], "place", ["part"])
    size = df.groupBy("part").agg(F.count("*").alias("n"))
    return order.join(size, "part").select("part", "gnum", (F.col("n") - F.col("place") + 1).cast("int").alias("lnum"))


def pieces_of(nodes: DataFrame, near: DataFrame, most: int = 60) -> DataFrame:
    """(part, gnum, piece): the smallest gnum that a vertex of the part hangs together with, by rounds of least labels
    among neighbours, each doubled by a look at the label's own label."""
    now = materialise(nodes.select("part", "gnum", F.col("gnum").alias("piece")))
    for _ in range(most):
        seen = near.join(now.select("part", F.col("gnum").alias("dst"), "piece"), ["part", "dst"]).groupBy("part", F.col("src").alias("gnum")).agg(F.min("piece").alias("other"))
        low = now.join(seen, ["part", "gnum"], "left").select("part", "gnum", F.col("piece").alias("old"), F.least("piece", F.coalesce("other", "piece")).alias("low"))
        far = low.select("part", F.col("gnum").alias("low"), F.col("low").alias("far"))
        step = materialise(low.join(far, ["part", "low"]).select("part", "gnum", "old", F.least("low", "far").alias("piece")))
        now = step.select("part", "gnum", "piece")
        if not step.where("old <> piece").limit(1).count():
            return now
    raise RuntimeError("pieces did not settle")


register_renumbering("natural", assemble)
register_renumbering("random", renumber_random)


def localise(conn: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Global (src, pos, dst) as (part, src, pos, dst) in local numbers; src, dst: (part, gnum, lnum). Signs stay; rows go
    to every part that has both sides."""
    a = src.select("part", F.col("gnum").alias("src"), F.col("lnum").alias("_s"))
    b = dst.select("part", F.col("gnum").alias("_a"), F.col("lnum").alias("_d"))
    met = conn.withColumn("_a", F.abs("dst")).join(a, "src").join(b, ["part", "_a"])
    return met.select("part", F.col("_s").alias("src"), "pos", (F.col("_d") * sign("dst")).cast("long").alias("dst"))


def entities_of(split: DataFrame, conn: DataFrame) -> DataFrame:
    """(part, gnum): the dst that the entities of each part cite."""
    return conn.join(split.select("part", F.col("gnum").alias("src")), "src").select("part", F.abs("dst").alias("gnum")).distinct()


def partition_mesh(split: DataFrame, cell_face: DataFrame, face_vtx: DataFrame, groups: DataFrame | None = None, renumber: str = "natural") -> Frames:
    """A mesh by parts, end to end. split: (gnum, part) of the cells, by any split; groups: (kind, group, gnum) of faces.

    cells, faces, vertices: (part, gnum, lnum), cells numbered by the registered method, the others by gnum. cell_face,
    face_vtx: (part, src, pos, dst) in local numbers. face_cell: (part, face, c1, c2), the local cell that walks the face
    outwards and the one that walks it inwards, 0 where there is none in the part. groups: (part, kind, group, lnum).
    face_graph, vertex_graph: which copies of faces and vertices are one, (gnum, rank, part, lnum, o_rank, o_part, o_lnum)
    with rank 0. cell_face_ids, face_vtx_ids: the connectivities given, (src, pos, dst) in global ids. Each frame is made when
    it is first read.
    """
    side = lambda c: F.coalesce(F.max(F.when(c, F.col("src"))), F.lit(0)).cast("int")
    graph = lambda n: lambda f: shared_graph(f[n].select(F.lit(0).alias("rank"), "part", "lnum", "gnum"))
    out = {
        "cells": lambda f: materialise(RENUMBERINGS[renumber](split.select("part", "gnum")).select("part", "gnum", "lnum")),
        "faces": lambda f: materialise(assemble(entities_of(f["cells"], cell_face))),
        "vertices": lambda f: materialise(assemble(entities_of(f["faces"], face_vtx))),
        "cell_face": lambda f: localise(cell_face, f["cells"], f["faces"]),
        "face_vtx": lambda f: localise(face_vtx, f["faces"], f["vertices"]),
        "face_cell": lambda f: f["cell_face"].groupBy("part", F.abs("dst").alias("face")).agg(side(F.col("dst") > 0).alias("c1"), side(F.col("dst") < 0).alias("c2")),
        "face_graph": graph("faces"), "vertex_graph": graph("vertices"), "cell_face_ids": lambda f: cell_face, "face_vtx_ids": lambda f: face_vtx,
    }
    if groups is not None:
        out["groups"] = lambda f: groups.join(f["faces"], "gnum").select("part", "kind", "group", "lnum")
    return Frames(out)


def ghost_layers(cells: DataFrame, conn: DataFrame, depth: int = 1) -> DataFrame:
    """(part, gnum, layer): cells within depth steps of each part over shared dst, layer 0 being the part's own. Each layer
    goes from the frontier to the entities that it is the first to reach, and from those to their cells."""
    links = materialise(conn.select(F.col("src").alias("gnum"), F.abs("dst").alias("ent")).distinct())
    out = materialise(cells.select("part", "gnum", F.lit(0).alias("layer")))
    front, seen = out, None
    for k in range(1, depth + 1):
        reached = front.join(links, "gnum").select("part", "ent").distinct()
        fresh = materialise(reached if seen is None else absent(reached, seen, ["part", "ent"]))
        seen = fresh if seen is None else seen.unionByName(fresh)
        # a cell gets the parts of each of its entities as an array, and only there do they become rows
        parts = materialise(lists(fresh, "ent", "part", "parts"))
        step = spread_join(links, parts, ["ent"]).select("gnum", "parts").repartition("gnum").select(F.explode("parts").alias("part"), "gnum").distinct()
        front = materialise(absent(step, out, ["part", "gnum"]).withColumn("layer", F.lit(k)))
        out = out.unionByName(front)
    return out


def coarsen(df: DataFrame, size: int) -> DataFrame:
    """Agglomerates of `size` consecutive local cells of a part: coarse ids and their parent map."""
    return assemble(df).withColumn("coarse", F.floor((F.col("lnum") - 1) / size).cast("int") + 1)
