"""Agglomeration of cells along a graph, and the coarse mesh that it leaves.

Heavy-edge matching: every free cell proposes to the free neighbour across its heaviest edge, ties by a hash that both ends
share, so that an edge heavier than all around it is proposed from both ends and its cells pair up. Rounds go on until no
edge between free cells within the size bound is left; then pairs contract, their edges add up, and the next level pairs the
pairs. Groups grow along edges, so they hang together, and none exceeds the bound.

Defined results: cells without edges stay alone; repeated edges add up; edges from a cell to itself, and to unknown cells,
count for nothing; a null weight counts as 0; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tables import materialise, numbered
from gridloom.operators.ids import from_keys

COARSENINGS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {}


def register_coarsening(name: str, method: Callable[[DataFrame, DataFrame, int], DataFrame]) -> None:
    """A method takes cells (gnum), a graph (src, dst, weight) and the largest group, and gives (gnum, coarse), dense."""
    COARSENINGS[name] = method


def consecutive(cells: DataFrame, graph: DataFrame, largest: int) -> DataFrame:
    """Groups of consecutive cells, without regard to the graph."""
    return numbered(cells.select("gnum").distinct(), ["gnum"], "_k").select("gnum", (F.floor((F.col("_k") - 1) / largest) + 1).cast("long").alias("coarse"))


def pairs_of(edges: DataFrame) -> DataFrame | None:
    """(a, b, sa, sb): a matching over edges (a, b, weight, sa, sb), a < b, each once, sa and sb the sizes of their ends, that
    no edge could still extend; None without edges. A round shuffles each end of an edge once, the wishes by their pairs, and
    the edges by either end; the edges left are a part of those before."""
    left, found = edges, None
    while True:
        end = lambda p, q: F.struct(F.col(p).alias("src"), F.struct("weight", F.xxhash64("a", "b").alias("tie"), F.col(q).alias("to"), F.col(f"s{p}").alias("own"), F.col(f"s{q}").alias("other")).alias("m"))
        wish = left.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).groupBy(F.col("e.src").alias("src")).agg(F.max("e.m").alias("m"))
        first = F.col("src") < F.col("m.to")
        side = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
        each = wish.select(F.least("src", "m.to").alias("a"), F.greatest("src", "m.to").alias("b"), side("m.own", "m.other").alias("sa"), side("m.other", "m.own").alias("sb"))
        met = materialise(each.groupBy("a", "b", "sa", "sb").agg(F.count("*").alias("n")).where("n = 2").drop("n"))
        if not met.limit(1).count():
            return found
        found = met if found is None else found.unionByName(met)
        taken = met.select(F.explode(F.array("a", "b")).alias("gnum"))
        for c in ("a", "b"):
            left = left.join(taken.withColumnRenamed("gnum", c), c, "left_anti")
        left = materialise(left.select(*edges.columns))


def heavy_edges(cells: DataFrame, graph: DataFrame, largest: int) -> DataFrame:
    """Groups of at most `largest` cells by heavy-edge matching, level by level. An edge is a row, which carries the sizes of
    its two groups; one that would make too large a group goes for good, as groups only grow."""
    known = materialise(cells.select("gnum").distinct())
    once = graph.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    for c in ("a", "b"):
        once = once.join(known.withColumnRenamed("gnum", c), c, "left_semi")
    one = [F.lit(1).cast("long").alias(c) for c in ("sa", "sb")]
    edges = materialise(once.groupBy("a", "b").agg(F.sum("weight").alias("weight")).select("a", "b", "weight", *one).where(F.lit(largest >= 2)))
    now = known.withColumn("group", F.col("gnum"))
    while True:
        pairs = pairs_of(edges)
        if pairs is None:
            return from_keys(now, ["group"], "coarse").select("gnum", "coarse")
        parent = pairs.select(F.col("b").alias("group"), F.col("a").alias("_new"))
        now = materialise(now.join(parent, "group", "left").select("gnum", F.coalesce("_new", "group").alias("group")))
        # what either end of a pair becomes, and what its group grows by
        into = pairs.select(F.explode(F.array(*[F.struct(F.col(p).alias("old"), F.col("a").alias("new"), F.col(f"s{q}").alias("more")) for p, q in ("ab", "ba")])).alias("i")).select("i.*")
        moved = edges
        for c in ("a", "b"):
            met = moved.join(into.withColumnRenamed("old", c), c, "left")
            moved = met.withColumns({c: F.coalesce("new", c), f"s{c}": F.col(f"s{c}") + F.coalesce("more", F.lit(0))}).drop("new", "more")
        moved = moved.where((F.col("a") != F.col("b")) & (F.col("sa") + F.col("sb") <= largest))
        ahead = F.col("a") < F.col("b")
        sized = [F.when(ahead, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("sa", "sb"), ("sb", "sa"))]
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", *sized)
        edges = materialise(moved.groupBy("a", "b").agg(F.sum("weight").alias("weight"), *[F.first(c).alias(c) for c in ("sa", "sb")]))


register_coarsening("consecutive", consecutive)
register_coarsening("heavy", heavy_edges)


def cell_graph(cell_face: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) of cells on the two sides of a face (src, pos, signed dst); areas: (face, weight), else 1 a face."""
    side = lambda out, name: cell_face.where(F.col("dst") > 0 if out else F.col("dst") < 0).select(F.abs("dst").alias("face"), F.col("src").alias(name))
    met = side(True, "src").join(side(False, "dst"), "face")
    met = met.withColumn("weight", F.lit(1.0)) if areas is None else met.join(areas, "face")
    return met.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def coarse_mesh(groups: DataFrame, cell_face: DataFrame) -> dict[str, DataFrame]:
    """groups: (gnum, coarse); cell_face: (src, pos, dst), a positive dst on the cell that its normal leaves.

    faces: (gnum, c1, c2), dense: the coarse faces, one for each two coarse cells that touch and one for each coarse cell's
    border (c2 = 0), turned out of c1. face_map: (face, coarse_face), signed by whether the fine face turns the same way;
    inner faces have no row. cell_face: (src, pos, dst) of the coarse mesh."""
    of = cell_face.join(groups.select(F.col("gnum").alias("src"), "coarse"), "src").select(F.abs("dst").alias("face"), (F.col("dst") > 0).alias("out"), "coarse")
    side = lambda out: F.max(F.when(F.col("out") == out, F.col("coarse")))
    fine = materialise(of.groupBy("face").agg(F.coalesce(side(True), F.lit(0)).alias("a"), F.coalesce(side(False), F.lit(0)).alias("b")).where("a <> b"))
    # a border face turns out of its only cell, the others out of the lower one
    lead = F.when((F.col("a") == 0) | (F.col("b") == 0), F.greatest("a", "b")).otherwise(F.least("a", "b"))
    keyed = fine.select("face", lead.alias("c1"), (F.col("a") + F.col("b") - lead).alias("c2"), (F.col("a") == lead).alias("same"))
    named = materialise(from_keys(keyed, ["c1", "c2"], "gnum"))
    faces = named.select("gnum", "c1", "c2").distinct()
    sides = faces.select(F.col("c1").alias("src"), F.col("gnum").alias("dst")).unionByName(faces.where("c2 > 0").select(F.col("c2").alias("src"), (-F.col("gnum")).alias("dst")))
    ordered = numbered(sides.withColumn("_a", F.abs("dst")), ["_a"], "pos", ["src"]).select("src", "pos", "dst")
    return {"faces": faces, "face_map": named.select("face", F.when(F.col("same"), F.col("gnum")).otherwise(-F.col("gnum")).alias("coarse_face")), "cell_face": ordered}
