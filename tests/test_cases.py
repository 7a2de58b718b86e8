"""Results in time steps, polygons and polyhedra in files, fields of cells."""

import glob
import tempfile

import pytest
from pyspark.sql import functions as F

from gridloom.sources import cases, files, generators
from gridloom.sources.polygonal import lifted, polygon_rectangle


def text(folder):
    out = []
    for p in sorted(glob.glob(f"{folder}/part-*")):
        with open(p) as f:
            out += f.read().splitlines()
    return out


def rows(lines):
    return [[int(line[k : k + 10]) for k in range(0, len(line), 10)] for line in lines]


def test_steps_at_nodes_and_elements(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    v, e = generators.cube_vertices(spark, 3), generators.cube_cells(spark, 3)
    e = e.withColumn("elt_type", F.when(F.col("gnum") > 5, "tetra").otherwise("hexa"))
    steps = lambda d, *c: d.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("step", *d.columns, F.array(*c).alias("values"))
    at = steps(v, F.col("x") + F.col("step"), F.col("y"), F.col("z") * F.col("step"))
    p = steps(e, F.col("gnum") * 1.0 + F.col("step"))
    cases.write_case(path, v, e, {"speed": at.select("step", "gnum", "values"), "load": p.select("step", "gnum", "elt_type", "values")}, [0.0, 0.5, 1.0])
    case = text(f"{path}/case")
    assert "vector per node: 1 speed speed/step=*" in case and "scalar per element: 1 load load/step=*" in case and "time values: 0.0 0.5 1.0" in case
    got = {(r.step, r.kind, r.pos): r["values"] for r in cases.read_steps(spark, path, "speed", 3).collect()}
    want = {(r.step, "coordinates", r.gnum): r["values"] for r in at.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    got = {(r.step, r.kind, r.pos): r["values"] for r in cases.read_steps(spark, path, "load").collect()}
    assert got == {(s, "hexa8" if g < 6 else "tetra4", g if g < 6 else g - 5): [float(g + s)] for g in range(1, 9) for s in range(3)}
    with pytest.raises(ValueError):
        cases.write_case(tempfile.mkdtemp(prefix="spark-"), v, e, {"speed": at.select("step", "gnum", "values")}, [0.0])


def test_missing_entities_are_filled(spark):
    field = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0]), (4, 2, [4.0, 5.0, 6.0])], "step int, gnum long, values array<double>")
    got = {(r.step, r.gnum): r["values"] for r in cases.filled(field, spark.range(1, 3).select(F.col("id").alias("gnum"))).collect()}
    assert got == {(0, 1): [1, 2, 3], (0, 2): [0, 0, 0], (4, 1): [0, 0, 0], (4, 2): [4, 5, 6]}


def test_polygons_and_polyhedra(spark):
    faces, v = polygon_rectangle(spark, 2, 2)
    mesh = lifted(faces, v, 1)
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    flat = faces.select(F.col("gnum").alias("src"), F.posexplode("vtx").alias("pos", "dst"))
    files.write_lines(cases.geometry_lines(mesh["vertices"], polygons=flat, polyhedra=(mesh["cell_face"], mesh["face_vtx"])), path)
    lines = text(path)
    rings = {r["gnum"]: list(r["vtx"]) for r in faces.collect()}
    k, n = lines.index("nsided"), len(rings)
    assert int(lines[k + 1]) == n and rows(lines[k + 2 : k + 2 + n]) == [[len(rings[f])] for f in sorted(rings)] and rows(lines[k + 2 + n : k + 2 + 2 * n]) == [rings[f] for f in sorted(rings)]
    k = lines.index("nfaced")
    cells, all_faces = {}, {}
    for r in mesh["cell_face"].orderBy("src", "pos", F.abs("dst")).collect():
        cells.setdefault(r["src"], []).append(abs(r["dst"]))
    for r in mesh["face_vtx"].orderBy("src", "pos").collect():
        all_faces.setdefault(r["src"], []).append(r["dst"])
    order = [f for c in sorted(cells) for f in cells[c]]
    assert int(lines[k + 1]) == len(cells) and rows(lines[k + 2 : k + 2 + len(cells)]) == [[len(cells[c])] for c in sorted(cells)]
    k += 2 + len(cells)
    assert rows(lines[k : k + len(order)]) == [[len(all_faces[f])] for f in order] and rows(lines[k + len(order) : k + 2 * len(order)]) == [all_faces[f] for f in order]


def test_fields_of_cells(spark):
    v, e = generators.cube_vertices(spark, 3), generators.cube_cells(spark, 3)
    of = e.select(F.col("gnum").alias("cell"), (F.col("gnum") * 1.5).alias("value"))
    for extra in ({}, {"p": v.select("gnum", F.col("x").alias("value"))}):
        path = tempfile.mkdtemp(prefix="spark-") + "/out"
        files.write("vtk", path, v, e, q=of, r=of, **extra)
        got = {(r.kind, r.name, r.gnum): r.value for r in files.read_vtk_fields(spark, path).collect()}
        want = {("cell", n, r.cell): r.value for r in of.collect() for n in "qr"}
        if extra:
            want |= {("point", "p", r.gnum): r.x for r in v.collect()}
        assert got == want
