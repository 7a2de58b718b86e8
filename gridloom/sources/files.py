"""Mesh files as tables: ASCII STL is read, keyword meshes (.mesh) and legacy VTK are read and written, EnSight Gold is
written, all by Spark.

Readers number the lines of the (possibly split) file in file order with a range sort, find the few keyword lines, and
give every other line its section by an interval join with those; no file passes through one task or the driver.
Writers build a table of ordered lines and write it range-partitioned: the part files, in name order, are the file.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.tables import materialise, numbered
from gridloom.operators.ids import from_keys

FORMATS: dict[str, Callable[..., DataFrame]] = {}


def register_format(name: str, lines: Callable[..., DataFrame]) -> None:
    """A format turns (vertices, elements, **fields) into a table of lines (section, row, line)."""
    FORMATS[name] = lines


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): the trimmed, not empty lines of a file, or of a folder's files in name order, numbered from 1."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).withColumn("m", F.monotonically_increasing_id())
    kept = raw.withColumn("line", F.trim(F.regexp_replace("value", r"\s+", " "))).where("line <> ''")
    return materialise(numbered(kept.select("f", "b", "m", "line"), ["f", "b", "m"], "n").select("n", "line"))


def words(line: Column) -> Column:
    return F.split(line, " ")


def read_stl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (gnum, x, y, z), merged where coordinates are equal, and triangles (gnum, elt_type, vtx)."""
    v = lines_of(spark, path).where("line LIKE 'vertex %'")
    v = numbered(v, ["n"], "k").select("k", *[F.get(words(F.col("line")), F.lit(i + 1)).cast("double").alias(a) for i, a in enumerate("xyz")])
    named = materialise(from_keys(v, ["x", "y", "z"]))
    tri = named.groupBy(F.expr("(k - 1) div 3 + 1").alias("gnum")).agg(F.array_sort(F.collect_list(F.struct("k", "gnum"))).alias("c"))
    return named.select("gnum", "x", "y", "z").distinct(), tri.select("gnum", F.lit("triangle").alias("elt_type"), F.transform("c", lambda s: s["gnum"]).alias("vtx"))


MESH_SECTIONS = {"Edges": ("edge", 2), "Triangles": ("triangle", 3), "Quadrilaterals": ("quad", 4), "Tetrahedra": ("tetra", 4), "Pyramids": ("pyramid", 5), "Prisms": ("prism", 6), "Hexahedra": ("hexa", 8)}


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Keyword mesh: vertices (gnum, x, y, z, ref) and elements (gnum, elt_type, vtx, ref), numbered section by section."""
    lines = lines_of(spark, path).where("line NOT LIKE '#%'")
    heads = lines.where(F.col("line").rlike("^[A-Za-z]")).orderBy("n").collect()  # a line a section
    found = [(h["line"].split(" ")[0], h["n"], heads[i + 1]["n"] if i + 1 < len(heads) else 1 << 62) for i, h in enumerate(heads)]
    sections = F.broadcast(spark.createDataFrame(found, "section string, lo long, hi long"))
    rows = lines.join(sections, (F.col("n") > F.col("lo")) & (F.col("n") < F.col("hi")))
    w = words(F.col("line"))
    v = numbered(rows.where("section = 'Vertices'").where(F.size(w) > 2), ["n"])
    vertices = v.select("gnum", *[F.get(w, F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")], F.element_at(w, -1).cast("int").alias("ref"))
    elements = None
    for name, (kind, n) in MESH_SECTIONS.items():
        e = numbered(rows.where((F.col("section") == name) & (F.size(w) > n)), ["n"])
        e = e.select("gnum", F.lit(kind).alias("elt_type"), F.transform(F.slice(w, 1, n), lambda x: x.cast("long")).alias("vtx"), F.element_at(w, -1).cast("int").alias("ref"))
        elements = e if elements is None else elements.unionByName(e)
    return vertices, elements


VTK_TYPES = {1: "point", 3: "edge", 5: "triangle", 9: "quad", 10: "tetra", 12: "hexa", 13: "prism", 14: "pyramid", 7: "polygon"}
VTK_CODES = {v: k for k, v in VTK_TYPES.items()}


def read_vtk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Legacy VTK with POINTS and CELLS or POLYGONS: vertices and elements (gnum, elt_type, vtx, 1-based)."""
    lines = lines_of(spark, path)
    heads = lines.where(F.col("line").rlike("^[A-Z_]{5,}") & (F.col("n") > 2)).orderBy("n").collect()
    found = [(h["line"].split(" ")[0], h["n"], heads[i + 1]["n"] if i + 1 < len(heads) else 1 << 62) for i, h in enumerate(heads)]
    sections = F.broadcast(spark.createDataFrame(found, "section string, lo long, hi long"))
    rows = materialise(lines.join(sections, (F.col("n") > F.col("lo")) & (F.col("n") < F.col("hi"))))
    token = lambda s: numbered(rows.where(F.col("section") == s).select("n", F.posexplode(words(F.col("line"))).alias("p", "w")), ["n", "p"], "k")
    at = token("POINTS").select(F.expr("(k - 1) div 3 + 1").alias("gnum"), F.expr("(k - 1) % 3").alias("a"), F.col("w").cast("double").alias("w"))
    vertices = at.groupBy("gnum").agg(*[F.max(F.when(F.col("a") == i, F.col("w"))).alias(a) for i, a in enumerate("xyz")])
    names = {r[0] for r in found}
    cells = rows.where(F.col("section").isin("CELLS", "POLYGONS"))
    cells = numbered(cells, ["n"]).select("gnum", F.transform(F.slice(words(F.col("line")), F.lit(2), F.size(words(F.col("line"))) - 1), lambda x: x.cast("long") + 1).alias("vtx"))
    if "CELL_TYPES" in names:
        kinds = F.create_map(*[x for k, v in VTK_TYPES.items() for x in (F.lit(k), F.lit(v))])
        types = token("CELL_TYPES").select(F.col("k").alias("gnum"), kinds[F.col("w").cast("int")].alias("elt_type"))
        return vertices, cells.join(types, "gnum").select("gnum", "elt_type", "vtx")
    return vertices, cells.select("gnum", F.when(F.size("vtx") == 3, "triangle").when(F.size("vtx") == 4, "quad").otherwise("polygon").alias("elt_type"), "vtx")


def read_vtk_fields(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, gnum, comp, value): the scalar and vector fields of points and cells of a legacy VTK file."""
    lines = lines_of(spark, path)
    heads = [(h["line"].split(" "), h["n"]) for h in lines.where(F.col("line").rlike("^[A-Z_]{5,}") & (F.col("n") > 2)).orderBy("n").collect()]  # a line a section
    found, kind, name, comps = [], None, None, 1
    for k, (head, n) in enumerate(heads):
        last = heads[k + 1][1] if k + 1 < len(heads) else 1 << 62
        if head[0] in ("POINT_DATA", "CELL_DATA"):
            kind = head[0][:-5].lower()
        elif head[0] == "SCALARS":
            name, comps = head[1], int(head[3]) if len(head) > 3 else 1
        elif head[0] == "LOOKUP_TABLE" and name:
            found.append((kind, name, comps, n, last))
        elif head[0] == "VECTORS":
            found.append((kind, head[1], 3, n, last))
    sections = F.broadcast(spark.createDataFrame(found, "kind string, name string, comps int, lo long, hi long"))
    rows = lines.join(sections, (F.col("n") > F.col("lo")) & (F.col("n") < F.col("hi"))).select("kind", "name", "comps", "n", F.posexplode(words(F.col("line"))).alias("p", "w"))
    at = numbered(rows, ["n", "p"], "k", ["kind", "name"])
    return at.select("kind", "name", F.expr("(k - 1) div comps + 1").alias("gnum"), F.expr("cast((k - 1) % comps AS int)").alias("comp"), F.col("w").cast("double").alias("value"))


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """(gnum, values array<double>): the solution at the vertices of a keyword file."""
    lines = lines_of(spark, path).where("line NOT LIKE '#%'")
    start = lines.where("line LIKE 'SolAtVertices%'").first()["n"]
    end = lines.where(F.col("line").rlike("^[A-Za-z]") & (F.col("n") > start)).agg(F.min("n")).first()[0] or 1 << 62
    rows = numbered(lines.where((F.col("n") > start + 2) & (F.col("n") < end)), ["n"])
    return rows.select("gnum", F.transform(words(F.col("line")), lambda x: x.cast("double")).alias("values"))


def solution_lines(values: DataFrame, kinds: list[int]) -> DataFrame:
    """Lines of a solution file for (gnum, values); kinds: 1 for each scalar, 2 for a vector, 3 for a metric."""
    heads = {0: f"MeshVersionFormatted 2\nDimension 3\nSolAtVertices\n{values.count()}\n{len(kinds)} {' '.join(map(str, kinds))}", 2: "End"}
    rows = values.select(F.lit(1).alias("section"), F.col("gnum").alias("row"), F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("line"))
    return rows.union(_heads(values.sparkSession, heads))


def ensight_variable_lines(name: str, field: DataFrame) -> DataFrame:
    """Lines of an EnSight Gold file of one scalar per node: (gnum, value) in the order of gnum."""
    rows = field.select(F.lit(1).alias("section"), F.col("gnum").alias("row"), F.format_string("%12.5e", "value").alias("line"))
    return rows.union(_heads(field.sparkSession, {0: f"{name}\npart\n{1:>10}\ncoordinates"}))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (section, row, line) as ordered part files."""
    lines.repartitionByRange("section", "row").sortWithinPartitions("section", "row").select("line").write.text(path)


def _heads(spark: SparkSession, texts: Mapping[int, str]) -> DataFrame:
    return spark.createDataFrame([(s, 0, t) for s, t in texts.items()], "section int, row long, line string")


def vtk_lines(vertices: DataFrame, elements: DataFrame, **fields: DataFrame) -> DataFrame:
    """Lines of a legacy VTK unstructured grid; fields: name to (gnum, value) at vertices, or
    to (cell, value) of elements."""
    spark = vertices.sparkSession
    n, e = vertices.count(), elements.agg(F.count("*"), F.sum(F.size("vtx") + 1)).first()
    codes = F.create_map(*[x for k, v in VTK_CODES.items() for x in (F.lit(k), F.lit(v))])
    heads = {0: f"# vtk DataFile Version 2.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {n} double", 2: f"CELLS {e[0]} {e[1] or 0}", 4: f"CELL_TYPES {e[0]}"}
    out = [vertices.select(F.lit(1).alias("section"), F.col("gnum").alias("row"), F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"]).alias("line"))]
    out.append(elements.select(F.lit(3), "gnum", F.concat_ws(" ", F.size("vtx").cast("string"), F.array_join(F.transform("vtx", lambda v: (v - 1).cast("string")), " "))))
    out.append(elements.select(F.lit(5), "gnum", codes[F.col("elt_type")].cast("string")))
    cells = {name: f for name, f in fields.items() if "cell" in f.columns}
    points = {name: f for name, f in fields.items() if name not in cells}
    for k, (name, f) in enumerate([*points.items(), *cells.items()]):
        start = f"POINT_DATA {n}\n" if k == 0 and points else f"CELL_DATA {e[0]}\n" if k == len(points) else ""
        heads[6 + 2 * k] = f"{start}SCALARS {name} double 1\nLOOKUP_TABLE default"
        out.append(f.select(F.lit(7 + 2 * k), "cell" if name in cells else "gnum", F.col("value").cast("string")))
    lines = _heads(spark, heads)
    for x in out:
        lines = lines.union(x)
    return lines


def mesh_lines(vertices: DataFrame, elements: DataFrame) -> DataFrame:
    """Lines of a keyword mesh."""
    ref = lambda d: F.col("ref") if "ref" in d.columns else F.lit(0)
    heads = {0: f"MeshVersionFormatted 2\nDimension 3\nVertices\n{vertices.count()}"}
    sizes = {r["elt_type"]: r["count"] for r in elements.groupBy("elt_type").count().collect()}
    lines = vertices.select(F.lit(1).alias("section"), F.col("gnum").alias("row"), F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"], ref(vertices).cast("string")).alias("line"))
    at = 2
    for name, (kind, _) in MESH_SECTIONS.items():
        if kind in sizes:
            heads[at] = f"{name}\n{sizes[kind]}"
            e = elements.where(F.col("elt_type") == kind)
            lines = lines.union(e.select(F.lit(at + 1), "gnum", F.concat_ws(" ", F.array_join(F.transform("vtx", lambda v: v.cast("string")), " "), ref(elements).cast("string"))))
            at += 2
    heads[at] = "End"
    return lines.union(_heads(vertices.sparkSession, heads))


ENSIGHT = {"point": "point", "edge": "bar2", "triangle": "tria3", "quad": "quad4", "tetra": "tetra4", "pyramid": "pyramid5", "prism": "penta6", "hexa": "hexa8"}


def ensight_lines(vertices: DataFrame, elements: DataFrame) -> DataFrame:
    """Lines of an EnSight Gold ASCII geometry: coordinates axis by axis, then connectivity by element type."""
    v = numbered(vertices, ["gnum"], "at")
    heads = {0: f"Geometry\ncreated by spark\nnode id assign\nelement id assign\npart\n{1:>10}\nmesh\ncoordinates\n{v.count():>10}"}
    lines = None
    for k, a in enumerate("xyz"):
        x = v.select(F.lit(1 + k).alias("section"), F.col("at").alias("row"), F.format_string("%12.5e", a).alias("line"))
        lines = x if lines is None else lines.union(x)
    sizes = {r["elt_type"]: r["count"] for r in elements.groupBy("elt_type").count().collect()}
    at, section = v.select(F.col("gnum").alias("v"), "at"), 4
    for kind, name in ENSIGHT.items():
        if kind in sizes:
            heads[section] = f"{name}\n{sizes[kind]:>10}"
            e = elements.where(F.col("elt_type") == kind).select("gnum", F.posexplode("vtx").alias("pos", "v")).join(at, "v")
            e = e.groupBy("gnum").agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("c"))
            lines = lines.union(e.select(F.lit(section + 1), "gnum", F.array_join(F.transform("c", lambda s: F.lpad(s["at"].cast("string"), 10, " ")), "")))
            section += 2
    return lines.union(_heads(vertices.sparkSession, heads))


def ensight_case(geometry: str, variables: Mapping[str, str], times: list[float]) -> str:
    """Text of the case file; variables: name to file pattern."""
    out = ["FORMAT", "type: ensight gold", "GEOMETRY", f"model: {geometry}"]
    if variables:
        out += ["VARIABLE", *[f"scalar per node: 1 {n} {p}" for n, p in variables.items()]]
    out += ["TIME", "time set: 1", f"number of steps: {len(times)}", "filename start number: 1", "filename increment: 1", "time values: " + " ".join(map(str, times))]
    return "\n".join(out) + "\n"


for _name, _f in (("vtk", vtk_lines), ("mesh", mesh_lines), ("ensight", ensight_lines)):
    register_format(_name, _f)


def write(fmt: str, path: str, vertices: DataFrame, elements: DataFrame, **fields: DataFrame) -> None:
    """Write the lines of a registered format as ordered part files."""
    write_lines(FORMATS[fmt](vertices, elements, **fields), path)


def write_block(df: DataFrame, path: str, by: str = "gnum") -> None:
    """A block frame in id order, in range partitions."""
    df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(path)


def read_by_ids(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Rows of a written block by id: an indirection is a join."""
    return ids.join(spark.read.parquet(path), "gnum")
