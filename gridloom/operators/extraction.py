"""Sub-meshes of partitioned meshes, dealt over parts anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tables import Frames, materialise, numbered
from gridloom.operators import connectivity, partition
from gridloom.operators.exchange import shared_graph

LEVELS = ("cells", "faces", "vertices")


def globalise(local: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Local (part, src, pos, dst) as global (src, pos, dst), each row of a source once, whoever holds it. src, dst: (part,
    gnum, lnum)."""
    a = src.select("part", F.col("lnum").alias("src"), F.col("gnum").alias("_s"))
    b = dst.select("part", F.col("lnum").alias("_a"), F.col("gnum").alias("_d"))
    met = local.withColumn("_a", F.abs("dst")).join(a, ["part", "src"]).join(b, ["part", "_a"])
    return met.select(F.col("_s").alias("src"), "pos", (F.col("_d") * connectivity.sign("dst")).alias("dst")).distinct()


def origins(own: DataFrame) -> DataFrame:
    """(parent, from_part, from_lnum): the first part that holds each entity of (part, gnum, lnum), and its place there."""
    return own.groupBy(F.col("gnum").alias("parent")).agg(F.min(F.struct("part", "lnum")).alias("m")).select("parent", F.col("m.part").alias("from_part"), F.col("m.lnum").alias("from_lnum"))


def extract_parts(mesh: dict[str, DataFrame], chosen: DataFrame | None = None, parts: int | None = None, centers: DataFrame | None = None, curve: str = "hilbert", target: DataFrame | None = None) -> Frames:
    """The chosen cells (part, lnum) of a mesh as partition_mesh gives it, as a partitioned mesh of the same form.

    Where the cells go: without parts they stay in theirs; parts alone deals them evenly in the order of their ids; with
    centers (gnum, x, y, z) of the mesh's cells evenly along a curve; target (part, gnum) says for each part which cells of
    the mesh it gets, a cell as often as it is asked for, and chooses them itself.

    Entities have dense new ids in the order of their old ones; cells, faces and vertices also have parent (the old id),
    from_part and from_lnum (its first holder). Faces' groups go along. Defined results: cells chosen or asked for twice
    count once (a part), unknown ones not at all; without any cell all frames are empty.
    """
    if (chosen is None) == (target is None):
        raise ValueError("either chosen cells or a target")
    if target is not None and (parts is not None or centers is not None):
        raise ValueError("a target deals the cells itself")
    if centers is not None and parts is None:
        raise ValueError("a curve needs the number of parts")
    if target is not None:
        wanted = materialise(target.select("part", "gnum").distinct().join(mesh["cells"].select("gnum"), "gnum", "left_semi"))
    else:
        wanted = materialise(mesh["cells"].join(chosen.select("part", "lnum").distinct(), ["part", "lnum"], "left_semi").select("part", "gnum"))

    def kept(name: str, src: str, dst: str, of: DataFrame) -> DataFrame:
        """The global connectivity's rows whose sources are among `of` (src)."""
        ids = mesh[f"{name}_ids"] if f"{name}_ids" in mesh else globalise(mesh[name], mesh[src], mesh[dst])
        return materialise(ids.select("src", "pos", "dst").join(of.distinct(), "src", "left_semi").distinct())

    cell_face = kept("cell_face", "cells", "faces", wanted.select(F.col("gnum").alias("src")))
    wanted = materialise(wanted.join(cell_face.select(F.col("src").alias("gnum")).distinct(), "gnum", "left_semi"))
    cells = wanted.select("gnum").distinct()
    if parts is None:
        split = wanted.select("gnum", "part")
    elif centers is None:
        split = partition.implicit_split(cells, parts)
    elif not cells.limit(1).count():
        split = cells.select("gnum", F.lit(0).alias("part"))
    else:
        split = partition.curve_split(centers.join(cells, "gnum").select("gnum", *"xyz"), parts, curve)
    groups = None
    if "groups" in mesh:
        groups = mesh["groups"].join(mesh["faces"], ["part", "lnum"]).select("kind", "group", "gnum").distinct()
    # old ids order entities as the new ones do, so their local numbers are the same
    rings = Frames({"kept": lambda f: kept("face_vtx", "faces", "vertices", cell_face.select(F.abs("dst").alias("src")))})
    old = partition.partition_mesh(split.select("gnum", "part"), cell_face, cell_face.where("false"), groups)
    old.makers["vertices"] = lambda f: materialise(partition.assemble(partition.entities_of(f["faces"], rings["kept"])))
    old.makers["face_vtx"] = lambda f: partition.localise(rings["kept"], f["faces"], f["vertices"])
    ids = Frames({n: lambda _, n=n: materialise(numbered(old[n].select("gnum").distinct(), ["gnum"], "new")) for n in LEVELS})

    def named(n: str) -> DataFrame:
        new = ids[n].select(F.col("gnum").alias("parent"), F.col("new").alias("gnum"))
        return old[n].withColumnRenamed("gnum", "parent").join(new, "parent").join(origins(mesh[n]), "parent").select("part", "gnum", "lnum", "parent", "from_part", "from_lnum")

    def renamed(conn: DataFrame, src: str, dst: str) -> DataFrame:
        a, b = ids[src].select(F.col("gnum").alias("src"), F.col("new").alias("_s")), ids[dst].select(F.col("gnum").alias("_a"), F.col("new").alias("_d"))
        met = conn.withColumn("_a", F.abs("dst")).join(a, "src").join(b, "_a")
        return met.select(F.col("_s").alias("src"), "pos", (F.col("_d") * connectivity.sign("dst")).alias("dst"))

    def graph(n: str) -> DataFrame:
        own = old[n].join(ids[n], "gnum")
        return shared_graph(own.select(F.lit(0).alias("rank"), "part", "lnum", F.col("new").alias("gnum")))

    out = {n: lambda _, n=n: named(n) for n in LEVELS} | {n: lambda _, n=n: old[n] for n in old if n in ("cell_face", "face_vtx", "face_cell", "groups")}
    out |= {"face_graph": lambda _: graph("faces"), "vertex_graph": lambda _: graph("vertices")}
    out |= {"cell_face_ids": lambda _: renamed(cell_face, "cells", "faces"), "face_vtx_ids": lambda _: renamed(rings["kept"], "faces", "vertices")}
    return Frames(out)
