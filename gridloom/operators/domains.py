"""Several domains: merged blocks with their data, interfaces, their views and their translation to other entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tables import materialise, numbered
from gridloom.operators.connectivity import sign
from gridloom.operators.ids import from_keys
from gridloom.operators.periodic import IDENTITY


def reachable(nodes: DataFrame, pairs: DataFrame, most: int = 40) -> DataFrame:
    """(me, root): the smallest node that each node (me) reaches over pairs (a, b), in either direction. Each round takes
    the neighbours' least root and then that root's own, so long chains shorten by halves."""
    both = materialise(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    now = materialise(nodes.select("me", F.col("me").alias("root")))
    for _ in range(most):
        seen = both.join(now.select(F.col("me").alias("b"), "root"), "b").groupBy(F.col("a").alias("me")).agg(F.min("root").alias("near"))
        low = now.join(seen, "me", "left").select("me", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("low"))
        step = materialise(low.join(low.select(F.col("me").alias("low"), F.col("low").alias("far")), "low").select("me", "old", F.least("low", "far").alias("root")))
        now = step.select("me", "root")
        if not step.where("old <> root").limit(1).count():
            return now
    raise RuntimeError("sets of joined entities did not settle")


def entity(first: str, second: str) -> Column:
    return F.struct(F.col(first).cast("int").alias("block"), F.col(second).cast("long").alias("gnum"))


def stacked(blocks: Sequence[DataFrame]) -> DataFrame:
    """The blocks' rows with the column block, from 0."""
    every = None
    for k, b in enumerate(blocks):
        own = b.withColumn("block", F.lit(k))
        every = own if every is None else every.unionByName(own)
    return every


def merge_blocks(blocks: Sequence[DataFrame], same: DataFrame, most: int = 40) -> DataFrame:
    """blocks: frames with gnum; same: (block1, gnum1, block2, gnum2) pairs that are one entity. (block, gnum, new):
    one dense numbering, the smallest (block, gnum) of a merged set giving its place. Pairs that name no entity of the
    blocks join nothing."""
    every = stacked([b.select("gnum") for b in blocks])
    pairs = same.select(entity("block1", "gnum1").alias("a"), entity("block2", "gnum2").alias("b"))
    now = reachable(every.select(entity("block", "gnum").alias("me")), pairs, most)
    return from_keys(now.select("me.*", F.col("root.block").alias("rb"), F.col("root.gnum").alias("rg")), ["rb", "rg"], "new").select("block", "gnum", "new")


def leaders(numbers: DataFrame) -> DataFrame:
    """Of merge_blocks' numbers the rows of the smallest (block, gnum) of each new number."""
    return numbers.groupBy("new").agg(F.min(F.struct("block", "gnum")).alias("m")).select("m.*", "new")


def merge_data(blocks: Sequence[DataFrame], numbers: DataFrame) -> DataFrame:
    """Rows of the merged block under the new numbers: of entities that are one, the data of the smallest (block, gnum).
    Blocks may have several rows an entity; entities without rows stay without."""
    every = stacked(blocks)
    return every.join(leaders(numbers), ["block", "gnum"]).drop("block", "gnum").withColumnRenamed("new", "gnum").select(*blocks[0].columns)


def merge_connectivity(conns: Sequence[DataFrame], src: DataFrame, dst: DataFrame) -> DataFrame:
    """Connectivities (src, pos, dst) of the blocks as one under the new numbers of both sides (src, dst: as merge_blocks
    gives them). Of sources that are one, the smallest's rows; places and signs stay."""
    rows = stacked(conns).join(leaders(src).select("block", F.col("gnum").alias("src"), F.col("new").alias("_s")), ["block", "src"]).withColumn("_a", F.abs("dst"))
    out = rows.join(dst.select("block", F.col("gnum").alias("_a"), F.col("new").alias("_d")), ["block", "_a"])
    return out.select(F.col("_s").alias("src"), "pos", (F.col("_d") * sign("dst")).alias("dst"))


def ancestors(numbers: DataFrame) -> DataFrame:
    """(new, pos, block, gnum): the entities that each new one was made of, in order from 0."""
    return numbered(numbers, ["block", "gnum"], "pos", ["new"]).select("new", (F.col("pos") - 1).alias("pos"), "block", "gnum")


def as_graph(interfaces: DataFrame) -> DataFrame:
    """Pairs (domain1, gnum1, domain2, gnum2) of all interfaces as sets (graph, domain, gnum) of entities that hang
    together, numbered by their smallest members."""
    pairs = materialise(interfaces.select(entity("domain1", "gnum1").alias("a"), entity("domain2", "gnum2").alias("b")))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("me")).distinct()
    out = from_keys(reachable(nodes, pairs).select("me", F.col("root").alias("_root")), ["_root"], "graph")
    return out.select("graph", F.col("me.block").alias("domain"), "me.gnum")


def flat_view(interfaces: DataFrame) -> DataFrame:
    """(domain, gnum, pos, interface, o_domain, o_gnum): what meets each entity over the interfaces (interface, domain1,
    gnum1, domain2, gnum2), in order from 0. An interface is negative where the entity is the second of a pair."""
    near = interfaces.select(F.col("domain1").alias("domain"), F.col("gnum1").alias("gnum"), "interface", F.col("domain2").alias("o_domain"), F.col("gnum2").alias("o_gnum"))
    far = interfaces.select("domain2", "gnum2", -F.col("interface"), "domain1", "gnum1")
    out = numbered(near.union(far).distinct(), ["interface", "o_domain", "o_gnum"], "pos", ["domain", "gnum"])
    return out.select("domain", "gnum", (F.col("pos") - 1).alias("pos"), "interface", "o_domain", "o_gnum")


def place(points: DataFrame, transform: Sequence[float]) -> DataFrame:
    """points (x, y, z) moved by a 3 x 4 transform as periodic.translation, rotation and turn give it."""
    moved = [sum((F.col(a) * float(transform[4 * r + k]) for k, a in enumerate("xyz")), F.lit(float(transform[4 * r + 3]))) for r in range(3)]
    rest = [c for c in points.columns if c not in "xyz"]
    return points.select(*rest, *[m.alias(a) for m, a in zip(moved, "xyz", strict=True)]).select(*points.columns)


def gaps(interfaces: DataFrame, points: DataFrame, transforms: Mapping[int, Sequence[float]]) -> DataFrame:
    """(interface, pairs, worst): how far the first entity of a pair, moved by the interface's transform, lies from the
    second at most; points: (domain, gnum, x, y, z). Interfaces without a transform join entities at one place."""
    at = lambda n: points.select(F.col("domain").alias(f"domain{n}"), F.col("gnum").alias(f"gnum{n}"), *[F.col(a).alias(f"{a}{n}") for a in "xyz"])
    met = interfaces.join(at(1), ["domain1", "gnum1"]).join(at(2), ["domain2", "gnum2"])
    rows = F.create_map(*[x for i, t in transforms.items() for x in (F.lit(i), F.array(*[F.lit(float(v)) for v in t]))]) if transforms else None
    of = F.array(*[F.lit(v) for v in IDENTITY]) if rows is None else F.coalesce(F.try_element_at(rows, F.col("interface").cast("int")), F.array(*[F.lit(v) for v in IDENTITY]))
    met = met.withColumn("_t", of)
    off = F.lit(0.0)
    for r, a in enumerate("xyz"):
        moved = F.get("_t", F.lit(4 * r + 3))
        for k, b in enumerate("xyz"):
            moved = moved + F.get("_t", F.lit(4 * r + k)) * F.col(f"{b}1")
        off = off + F.pow(moved - F.col(f"{a}2"), 2)
    return met.groupBy("interface").agg(F.count("*").alias("pairs"), F.max(F.sqrt(off)).alias("worst"))


def faces_to_vertices(interface: DataFrame, face_vtx: DataFrame, turn: int = -1) -> DataFrame:
    """Interface of faces (interface, face1, face2) to vertices. Matching faces are walked from the same corner; those of
    the other side run backwards (turn = -1) or forwards (1) along (face, pos, vtx), pos from 0."""
    n = face_vtx.groupBy("face").agg(F.count("*").alias("n"))
    a = interface.join(face_vtx.select(F.col("face").alias("face1"), "pos", F.col("vtx").alias("vtx1")), "face1")
    a = a.join(n.withColumnRenamed("face", "face1"), "face1").withColumn("pos", F.pmod(F.col("pos") * turn, F.col("n")))
    b = face_vtx.select(F.col("face").alias("face2"), "pos", F.col("vtx").alias("vtx2"))
    return a.join(b, ["face2", "pos"]).select("interface", "vtx1", "vtx2").distinct()


def vertices_to_entities(pairs: DataFrame, entity_vtx: DataFrame) -> DataFrame:
    """Interface of vertices (interface, vtx1, vtx2) to edges or faces (entity, vtx array): entities all of whose
    vertices have partners match the entity of just those."""
    key = lambda c: F.array_sort(c)
    e = entity_vtx.select("entity", F.size("vtx").alias("n"), F.explode("vtx").alias("vtx1")).join(pairs, "vtx1")
    moved = e.groupBy("interface", "entity", "n").agg(F.array_sort(F.collect_set("vtx2")).alias("key")).where(F.size("key") == F.col("n"))
    other = entity_vtx.select(F.col("entity").alias("entity2"), key(F.col("vtx")).alias("key"))
    return moved.join(other, "key").select("interface", F.col("entity").alias("entity1"), "entity2")


def translate(points: DataFrame, vector: Sequence[float]) -> DataFrame:
    for a, v in zip("xyz", vector, strict=True):
        points = points.withColumn(a, F.col(a) + float(v))
    return points
