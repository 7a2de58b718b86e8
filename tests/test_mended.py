"""Faults of earlier versions: dense clusters in box joins, folders of part files, long group numbers, hot keys, splits."""

import time

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.tables import spread_join
from gridloom.operators import connectivity, elements, isosurface, partition, spatial
from gridloom.sources import files


def test_box_join_of_dense_clusters(spark):
    """60 % unit boxes apart, 40 % tiny ones in one unit cell that don't meet: work in proportion, and the same pairs."""
    n = 160_000
    k, side = F.col("id"), int(n ** (1 / 3)) + 1
    big = k % 10 < 6
    low = [F.when(big, (k if i == 0 else F.lit(0)) * 2.0 + 10).otherwise(((F.floor(k / side**i) % side) + 0.5) / side) for i in range(3)]
    size = F.when(big, 1.0).otherwise(1e-6)
    b = spark.range(n).select((k + 1).alias("gnum"), *[low[i].alias(f"{a}min") for i, a in enumerate("xyz")], *[(low[i] + size).alias(f"{a}max") for i, a in enumerate("xyz")])
    began = time.time()
    assert spatial.boxes_meet_within(b).count() == 0
    assert time.time() - began < 90
    rng = np.random.default_rng(1)
    rows = [(g, *(v for c in rng.uniform(0, 1, 3) for v in (float(c), float(c + s)))) for g, s in enumerate(10.0 ** rng.integers(-9, 1, 400) * (rng.random(400) > 0.1))]
    df = spark.createDataFrame(rows, "gnum long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    got = {(r.a_gnum, r.b_gnum) for r in spatial.boxes_meet_within(df).select("a_gnum", "b_gnum").collect()}
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and all(p[i] <= q[i + 1] and q[i] <= p[i + 1] for i in (1, 3, 5))}
    assert got == want


def test_folder_of_unequal_parts(spark, tmp_path):
    lines = [f"line {k}" for k in range(3918)]
    at = 0
    for part, n in enumerate((3, 2000, 5, 900, 1010)):
        (tmp_path / f"part-{part:05d}.txt").write_text("".join(f"{x}\n" for x in lines[at : at + n]))
        at += n
    got = [r.line for r in files.lines_of(spark, str(tmp_path)).orderBy("n").collect()]
    assert got == lines


def test_ridges_of_long_group_numbers(spark):
    """Groups that differ in their first digits, or are negative, are different groups."""
    edge_face = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 1)], "src long, dst long")
    groups = spark.createDataFrame([(1, 12345678901), (2, 5), (3, 92345678901), (4, 5), (5, -7)], "gnum long, group long")
    got = {r.edge: (r.groups, r.ridge) for r in connectivity.ridges(edge_face, groups).collect()}
    assert {e: g for e, (g, _) in got.items()} == {1: [5, 12345678901], 2: [5, 92345678901], 3: [-7, 12345678901]}
    assert [got[e][1] for e in (3, 1, 2)] == [1, 2, 3]


def test_cuthill_of_a_long_path(spark):
    """Every vertex has its place, however many levels there are."""
    n = 30
    nodes = spark.range(1, n + 1).select(F.lit(0).alias("part"), F.col("id").alias("gnum"))
    edges = spark.range(1, n).select(F.lit(0).alias("part"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.gnum: r.lnum for r in partition.renumber_cuthill(nodes, edges).collect()} == {k: n - k + 1 for k in range(1, n + 1)}


def test_join_on_a_hot_key(spark):
    """One key holds half of both sides: every pair once, and the hot key's rows in several tasks."""
    left = spark.range(600).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(500).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    want = left.join(right, "k")
    got = spread_join(left, right, ["k"], 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spread_join(left, right.limit(0), ["k"], 20).count() == 0


def test_splits_agree_on_shared_faces(spark):
    """Two cells over a common quadrilateral with both diagonals tried: the surface cut through them has no cracks."""
    rng = np.random.default_rng(2)
    for _ in range(4):
        ids = (rng.permutation(12) + 1).tolist()
        cells = [(1, "hexa", ids[:8]), (2, "hexa", [ids[1], ids[8], ids[9], ids[2], ids[5], ids[10], ids[11], ids[6]])]
        e = spark.createDataFrame(cells, "gnum long, elt_type string, vtx array<long>")
        t = elements.tetras_of(e).collect()
        shared = {ids[1], ids[2], ids[5], ids[6]}
        halves = [{frozenset(x for x in r.vtx if x in shared) for r in t if r.parent == c and len(shared.intersection(r.vtx)) == 3} for c in (1, 2)]
        assert halves[0] == halves[1] and len(halves[0]) == 2
    value = spark.createDataFrame([(k, 0.0, 0.0, 0.0, float(v)) for k, v in enumerate(rng.normal(size=13))], "gnum long, x double, y double, z double, value double")
    assert isosurface.cut_elements(e, value).count() > 0


def test_nearest_of_outliers(spark):
    """Targets far from a cluster, with ties, repeated places and one far source."""
    rng = np.random.default_rng(3)
    cluster = [(k + 1, *map(float, p)) for k, p in enumerate(np.rint(rng.uniform(0, 20, (3000, 3))) / 20)] + [(3001, 1e5, 0.0, 0.0)]
    far = [(k + 1, *map(float, p)) for k, p in enumerate(np.rint(rng.normal(0, 300, (60, 3))))] + [(61, 0.5, 0.5, 0.5), (62, 1e5, 1.0, 0.0), (63, 500.0, 500.0, 500.0)]
    schema = "gnum long, x double, y double, z double"
    got = {}
    for r in spatial.nearest(spark.createDataFrame(far, schema), spark.createDataFrame(cluster, schema), 4, rounds=1).collect():
        got.setdefault(r.gnum, {})[r.pos] = r.src
    places = np.array([c[1:] for c in cluster])
    for g, *p in far:
        d = ((places - np.array(p)) ** 2) @ np.ones(3)
        want = sorted(range(len(cluster)), key=lambda i: (d[i], i))[:4]
        assert [d[got[g][k] - 1] for k in range(1, 5)] == [d[i] for i in want] and got[g][1] == want[0] + 1
