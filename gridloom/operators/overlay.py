"""Overlay of planar meshes of convex polygons: exact pieces and their areas, in folds over arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import let
from gridloom.operators.spatial import boxes_meet


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def before(ring: Column, i: Column) -> Column:
    """The point before the i-th one of a ring."""
    return F.get(ring, F.pmod(i - 1, F.size(ring)))


def cut_by(ring: Column, a: Column, b: Column) -> Column:
    """The part of a convex ring to the left of the line from a to b."""
    side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    none = F.slice(ring, 1, 0)

    def kept(e: Column) -> Column:
        u = e["s"] / (e["s"] - e["t"])
        crossing = point(e["q"]["x"] + u * (e["p"]["x"] - e["q"]["x"]), e["q"]["y"] + u * (e["p"]["y"] - e["q"]["y"]))
        return F.concat(F.when((e["s"] < 0) != (e["t"] < 0), F.array(crossing)).otherwise(none), F.when(e["t"] >= 0, F.array(e["p"])).otherwise(none))

    edge = lambda p, i: let(F.struct(p.alias("p"), before(ring, i).alias("q")), lambda e: let(F.struct(e["p"].alias("p"), e["q"].alias("q"), side(e["q"]).alias("s"), side(e["p"]).alias("t")), kept))
    return F.flatten(F.transform(ring, edge))


def clip(subject: Column, window: Column) -> Column:
    """The part of a convex ring inside another one, both counter-clockwise arrays of points."""
    edges = F.transform(window, lambda b, i: F.struct(before(window, i).alias("a"), b.alias("b")))
    return F.aggregate(edges, subject, lambda out, e: cut_by(out, e["a"], e["b"]))


def area(ring: Column) -> Column:
    term = lambda b, i: let(before(ring, i), lambda a: a["x"] * b["y"] - a["y"] * b["x"])
    return F.aggregate(F.transform(ring, term), F.lit(0.0), lambda s, x: s + x) / 2


def overlay(left: DataFrame, right: DataFrame, least: float = 1e-15) -> DataFrame:
    """left, right: (gnum, ring array<struct x, y>), convex and counter-clockwise. (a_gnum, b_gnum, measure, piece) of
    pairs whose common area exceeds `least`. Candidates come from the box join; only they reach the clipping."""

    def boxed(d: DataFrame) -> DataFrame:
        ends = [f(F.col("ring").getField(k)).alias(f"{k}{n}") for k in "xy" for f, n in ((F.array_min, "min"), (F.array_max, "max"))]
        return d.select("gnum", "ring", *ends)

    met = boxes_meet(boxed(left), boxed(right), ["x", "y"]).select("a_gnum", "b_gnum", "a_ring", "b_ring")
    cut = met.select("a_gnum", "b_gnum", clip(F.col("a_ring"), F.col("b_ring")).alias("piece"))
    return cut.withColumn("measure", F.when(F.size("piece") > 2, area(F.col("piece"))).otherwise(0.0)).where(F.col("measure") > least).select("a_gnum", "b_gnum", "measure", "piece")
