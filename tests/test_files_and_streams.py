"""File round trips and streams."""

import glob
import tempfile

import pytest
from gridloom import streaming
from gridloom.sources import files, generators
from pyspark.sql import functions as F


def one_file(folder):
    """The part files of a folder, in name order, as one file."""
    path = tempfile.mktemp()
    with open(path, "w") as f:
        for p in sorted(glob.glob(f"{folder}/part-*")):
            with open(p) as part:
                f.write(part.read())
    return path


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("fmt, read", [("vtk", files.read_vtk), ("mesh", files.read_mesh)])
def test_round_trip(spark, fmt, read):
    v, e = generators.cube_vertices(spark, 4), generators.cube_cells(spark, 4)
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    extra = {"p": v.select("gnum", F.col("x").alias("value"))} if fmt == "vtk" else {}
    files.write(fmt, folder, v, e, **extra)
    v2, e2 = read(spark, one_file(folder))
    assert bag(v2.select("gnum", "x", "y", "z")) == bag(v) and bag(e2.select(e.columns)) == bag(e)


def test_fields_and_solutions(spark):
    v, e = generators.cube_vertices(spark, 4), generators.cube_cells(spark, 4)
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    files.write("vtk", folder, v, e, p=v.select("gnum", F.col("x").alias("value")), q=v.select("gnum", (F.col("y") * 2).alias("value")))
    got = {(r.kind, r.name, r.gnum, r.comp): r.value for r in files.read_vtk_fields(spark, one_file(folder)).collect()}
    assert got == {("point", n, r.gnum, 0): x for r in v.collect() for n, x in (("p", r.x), ("q", 2 * r.y))}
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    values = v.select("gnum", F.array("x", "y", "z", F.col("x") * 3).alias("values"))
    files.write_lines(files.solution_lines(values, [2, 1]), folder)
    assert bag(files.read_solution(spark, one_file(folder))) == bag(values)
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    files.write_lines(files.ensight_variable_lines("p", v.select("gnum", F.col("x").alias("value"))), folder)
    lines = open(one_file(folder)).read().split("\n")
    assert lines[:4] == ["p", "part", "         1", "coordinates"] and float(lines[5]) == pytest.approx(1 / 3, abs=1e-5)


def test_long_cells(spark):
    path = tempfile.mktemp(suffix=".vtk")
    with open(path, "w") as f:
        f.write("# vtk DataFile Version 2.0\nlong\nASCII\nDATASET POLYDATA\nPOINTS 1500 double\n" + "".join(f"{k} 0 0\n" for k in range(1500)) + "POLYGONS 1 1501\n1500 " + " ".join(map(str, range(1500))) + "\n")
    assert [len(r.vtx) for r in files.read_vtk(spark, path)[1].collect()] == [1500]


def test_spheres_and_balls(spark):
    from gridloom.operators import elements

    v, t = generators.icosphere(spark, 4, 2.0)
    assert v.count() == 10 * 16 + 2 and t.count() == 20 * 16
    assert all(abs(r.x**2 + r.y**2 + r.z**2 - 4) < 1e-9 for r in v.collect())
    for inner, want in ((0.0, 1.0), (0.5, 1 - 0.5**3)):
        v, e = generators.ball(spark, 6, 3, 1.0, inner)
        assert e.select("gnum").distinct().count() == e.count() == 20 * 36 * 3
        m = elements.measures(e, v).agg(F.sum("volume"), F.min("volume")).first()
        assert m[1] > 0 and abs(m[0] / (want * 4.18879) - 1) < 0.05


def test_stl(spark):
    path = tempfile.mktemp(suffix=".stl")
    tri = [[(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(1, 0, 0), (1, 1, 0), (0, 1, 0)]]
    with open(path, "w") as f:
        f.write("solid a\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"  vertex {x} {y} {z}\n" for x, y, z in t) + "endloop\nendfacet\n" for t in tri) + "endsolid a\n")
    v, t = files.read_stl(spark, path)
    at = {r.gnum: (r.x, r.y, r.z) for r in v.collect()}
    assert len(at) == 4 and [[at[i] for i in r.vtx] for r in t.orderBy("gnum").collect()] == tri


def test_ensight(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    files.write("ensight", folder, generators.cube_vertices(spark, 3), generators.cube_cells(spark, 3))
    lines = open(one_file(folder)).read().split("\n")
    assert lines[8].strip() == "27" and "hexa8" in lines and lines[lines.index("hexa8") + 1].strip() == "8"
    assert "number of steps: 2" in files.ensight_case("g.geo", {"p": "p.****"}, [0.0, 1.0])


def test_blocks(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/b"
    files.write_block(spark.range(100).select(F.col("id").alias("gnum"), (F.col("id") * 2).alias("v")), path)
    assert {r.v for r in files.read_by_ids(spark, path, spark.createDataFrame([(3,), (7,)], "gnum long")).collect()} == {6, 14}


def test_reduce_steps(spark):
    src = tempfile.mkdtemp(prefix="spark-") + "/in"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("gnum"), F.col("ts").cast("timestamp").alias("ts"), "value")
    e.write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = streaming.reduce_steps(stream, ["value"], "ts").writeStream.format("memory").queryName("steps").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("steps")
    assert got.agg(F.sum("n")).first()[0] == e.count()
    assert abs(got.agg(F.sum("sum_value")).first()[0] - e.agg(F.sum("value")).first()[0]) < 1e-6
