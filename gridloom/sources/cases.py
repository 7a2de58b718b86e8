"""Results in time steps as EnSight Gold cases: a geometry of typed elements, polygons and polyhedra, and variables at nodes
or elements, scalars, vectors or symmetric tensors, for each step. Every part of a case is a folder whose part files, in name
order, are the file; a variable has a folder `step=k` for each step, all written by one job.

Defined results: an entity that a step's field doesn't name has no line, so fields should name all (see `filled`); a step
without rows has no folder; an empty mesh gives a geometry of no coordinates and no elements.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.tables import materialise, numbered
from gridloom.sources.files import ENSIGHT, _heads, ensight_lines, words, write_lines

KINDS = {1: "scalar", 3: "vector", 6: "tensor symm"}
WIDTH = 10


def whole(c: Column) -> Column:
    return F.lpad(c.cast("string"), WIDTH, " ")


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, whole), "")


def ring_lines(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, n, line): each face's vertices by their places among the vertices; faces: (src, pos, dst)."""
    at = numbered(vertices.select("gnum"), ["gnum"], "at").select(F.col("gnum").alias("dst"), "at")
    rings = faces.join(at, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("c"))  # a face's corners
    return rings.select("src", F.size("c").alias("n"), joined(F.transform("c", lambda s: s["at"])).alias("line"))


def polygon_lines(faces: DataFrame, vertices: DataFrame, section: int = 0) -> DataFrame:
    """The block of general polygons (src, pos, dst): their number, their sizes, their vertices."""
    rings = materialise(ring_lines(faces, vertices))
    rows = rings.select(F.lit(section + 1).alias("section"), F.col("src").alias("row"), whole(F.col("n")).alias("line")).union(rings.select(F.lit(section + 2), "src", "line"))
    return rows.union(_heads(faces.sparkSession, {section: f"nsided\n{rings.count():>{WIDTH}}"}))


def polyhedron_lines(cell_face: DataFrame, face_vtx: DataFrame, vertices: DataFrame, section: int = 0) -> DataFrame:
    """The block of polyhedra: their number, how many faces each has, how many vertices each of those has, and these."""
    rings = ring_lines(face_vtx, vertices).withColumnRenamed("src", "face")
    used = numbered(cell_face.select("src", "pos", F.abs("dst").alias("face")).join(rings, "face"), ["src", "pos", "face"], "row")
    used = materialise(used)
    sizes = used.groupBy("src").agg(F.count("*").alias("n"))
    rows = sizes.select(F.lit(section + 1).alias("section"), F.col("src").alias("row"), whole(F.col("n")).alias("line"))
    rows = rows.union(used.select(F.lit(section + 2), "row", whole(F.col("n")))).union(used.select(F.lit(section + 3), "row", "line"))
    return rows.union(_heads(cell_face.sparkSession, {section: f"nfaced\n{sizes.count():>{WIDTH}}"}))


def geometry_lines(vertices: DataFrame, elements: DataFrame | None = None, polygons: DataFrame | None = None, polyhedra: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Lines of a geometry of typed elements (gnum, elt_type, vtx), then polygons (src, pos, dst), then polyhedra (cell_face,
    face_vtx)."""
    none = vertices.select("gnum", F.lit("").alias("elt_type"), F.array("gnum").alias("vtx")).where("false")
    lines = ensight_lines(vertices, none if elements is None else elements)
    first = 4 + 2 * len(ENSIGHT)
    if polygons is not None:
        lines = lines.union(polygon_lines(polygons, vertices, first))
    if polyhedra is not None:
        lines = lines.union(polyhedron_lines(*polyhedra, vertices, first + 3))
    return lines


def filled(field: DataFrame, entities: DataFrame, value: float = 0.0) -> DataFrame:
    """field (step, gnum, values) with a row for each of the entities (gnum and what else they have) in each of its steps:
    the missing ones hold the value."""
    steps = [r["step"] for r in field.select("step").distinct().collect()]  # a row a step
    every = entities.withColumn("step", F.explode(F.array(*[F.lit(k) for k in steps]).cast("array<int>")))
    n = field.agg(F.max(F.size("values"))).first()[0] or 1
    return every.join(field, ["step", "gnum"], "left").withColumn("values", F.coalesce("values", F.array_repeat(F.lit(float(value)), F.lit(n))))


def write_steps(name: str, field: DataFrame, path: str) -> None:
    """A variable's files, a folder a step. field: (step, gnum, values array<double>) at nodes; at elements with elt_type,
    the names of files.ENSIGHT, polygon or polyhedron. Components come one after another, as the format has it."""
    kinds = {k: (i, n) for i, (k, n) in enumerate([*ENSIGHT.items(), ("polygon", "nsided"), ("polyhedron", "nfaced")])}
    at_elements = "elt_type" in field.columns
    place = F.create_map(*[x for k, (i, _) in kinds.items() for x in (F.lit(k), F.lit(2 * i + 2))])[F.col("elt_type")] if at_elements else F.lit(2)
    rows = field.select("step", place.alias("section"), F.posexplode("values").alias("comp", "v"), F.col("gnum").alias("row"))
    lines = rows.select("step", "section", "comp", "row", F.format_string("%12.5e", "v").alias("line"))
    steps = rows.select("step").distinct()
    heads = steps.select("step", F.lit(0).alias("section"), F.lit(0).alias("comp"), F.lit(0).cast("long").alias("row"), F.lit(f"{name}\npart\n{1:>{WIDTH}}" + ("" if at_elements else "\ncoordinates")).alias("line"))
    if at_elements:
        names = F.create_map(*[x for i, n in kinds.values() for x in (F.lit(2 * i + 2), F.lit(n))])
        heads = heads.union(rows.select("step", "section").distinct().select("step", F.col("section") - 1, F.lit(0), F.lit(0).cast("long"), names[F.col("section")]))
    order = ["step", "section", "comp", "row"]
    lines.union(heads).repartitionByRange(*order).sortWithinPartitions(*order).select("step", "line").write.partitionBy("step").text(f"{path}/{name}")


def case_text(variables: Mapping[str, tuple[str, int]], times: Sequence[float]) -> str:
    """Text of the case file; variables: name to (node or element, components)."""
    out = ["FORMAT", "type: ensight gold", "GEOMETRY", "model: geometry"]
    if variables:
        out += ["VARIABLE", *[f"{KINDS[n]} per {where}: 1 {v} {v}/step=*" for v, (where, n) in variables.items()]]
    return "\n".join([*out, "TIME", "time set: 1", f"number of steps: {len(times)}", "filename start number: 0", "filename increment: 1", "time values: " + " ".join(map(str, times))])


def write_case(path: str, vertices: DataFrame, elements: DataFrame | None, fields: Mapping[str, DataFrame], times: Sequence[float], **blocks) -> None:
    """A whole case: geometry, the fields' steps (numbered from 0, one for each time) and the text that names them."""
    write_lines(geometry_lines(vertices, elements, **blocks), f"{path}/geometry")
    kinds = {}
    for name, field in fields.items():
        n = field.agg(F.min(F.size("values")), F.max(F.size("values")), F.min("step"), F.max("step")).first()
        if n[0] is not None and (n[0] != n[1] or n[0] not in KINDS or n[2] < 0 or n[3] >= len(times)):
            raise ValueError(f"{name}: values must all have 1, 3 or 6 components, and steps a time")
        kinds[name] = ("element" if "elt_type" in field.columns else "node", n[0] or 1)
        write_steps(name, field, path)
    write_lines(_heads(vertices.sparkSession, {0: case_text(kinds, times)}), f"{path}/case")


def read_steps(spark: SparkSession, path: str, name: str, components: int = 1) -> DataFrame:
    """(step, kind, pos, values): a variable's steps as write_steps writes them; kind is coordinates, or the block's name of
    the elements, pos the place in it from 1."""
    raw = spark.read.text(f"{path}/{name}").select("step", "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).withColumn("m", F.monotonically_increasing_id())
    lines = materialise(numbered(raw, ["f", "b", "m"], "n", ["step"]).select("step", "n", F.trim("value").alias("line")).where("n > 3"))
    heads = lines.where(F.col("line").rlike("^[a-z]")).select("step", F.col("n").alias("lo"), F.col("line").alias("kind"))  # a few lines a step
    after = heads.select("step", F.col("lo").alias("hi")).join(heads.select("step", "lo"), "step").where("hi > lo").groupBy("step", "lo").agg(F.min("hi").alias("hi"))
    sections = F.broadcast(heads.join(after, ["step", "lo"], "left").select(F.col("step").alias("s"), "lo", F.coalesce("hi", F.lit(1 << 62)).alias("hi"), "kind"))
    rows = lines.join(sections, (F.col("step") == F.col("s")) & (F.col("n") > F.col("lo")) & (F.col("n") < F.col("hi")))
    sizes = rows.groupBy("step", "kind").agg((F.count("*") / components).cast("long").alias("size"))
    k = F.col("n") - F.col("lo") - 1
    at = rows.join(sizes, ["step", "kind"]).select("step", "kind", (k % F.col("size") + 1).alias("pos"), F.floor(k / F.col("size")).alias("comp"), F.get(words(F.col("line")), F.lit(0)).cast("double").alias("v"))
    return at.groupBy("step", "kind", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("comp", "v"))), lambda s: s["v"]).alias("values"))  # a few components
