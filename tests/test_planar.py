"""Predicates, overlay and domains."""

import math

from gridloom.functions import geometry as G
from gridloom.functions import predicates as P
from gridloom.operators import domains, overlay
from gridloom.sources import generators
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_predicates(spark):
    p = lambda x, y: G.point(x, y, 0)
    assert one(spark, P.orient2d(p(0, 0), p(1, 0), p(0, 1))) > 0
    assert one(spark, P.in_circle(p(0, 0), p(1, 0), p(0, 1), p(0.6, 0.6))) > 0 > one(spark, P.in_circle(p(0, 0), p(1, 0), p(0, 1), p(2, 2)))
    assert one(spark, P.orient2d_sure(p(0, 0), p(1, 0), p(0, 1))) and not one(spark, P.orient2d_sure(p(0, 0), p(0.1, 0.1), p(0.3, 0.3)))
    q = [G.point(*x) for x in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
    assert one(spark, P.in_sphere(*q, G.point(0.4, 0.4, 0.4))) * one(spark, P.in_sphere(*q, G.point(2, 2, 2))) < 0 < one(spark, P.in_sphere(*q, G.point(0.4, 0.4, 0.4)))
    m = one(spark, P.line_meet(p(0, 0), p(1, 1), p(0, 1), p(1, 0)))
    assert (m.u, m.v) == (0.5, 0.5) and one(spark, P.line_meet(p(0, 0), p(1, 1), p(1, 0), p(2, 1))).u is None
    ring = F.array(p(0, 0), p(2, 0), p(2, 1), p(1, 0.5), p(0, 1))
    assert one(spark, P.in_polygon(p(0.2, 0.5), ring)) and not one(spark, P.in_polygon(p(1, 0.9), ring))
    w = one(spark, P.mean_values(p(0.3, 0.2), F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))))
    assert math.isclose(sum(w), 1) and math.isclose(w[1] + w[2], 0.3) and math.isclose(w[2] + w[3], 0.2)
    b = one(spark, F.array(*P.lagrange_triangle(2, F.lit(0.2), F.lit(0.3))))
    assert len(b) == 6 and math.isclose(sum(b), 1)
    t = lambda *x: F.array(*map(F.lit, x))
    assert [one(spark, P.same_cycle(t(1, 2, 3), t(*x))) for x in ((2, 3, 1), (3, 2, 1), (1, 2, 4))] == [1, -1, 0]


def test_overlay_conserves_area(spark):
    def rings(n, m, moved):
        v, q = generators.rectangle(spark, n, m)
        at = q.select("gnum", F.posexplode("vtx").alias("pos", "v")).join(v.select(F.col("gnum").alias("v"), F.struct((F.col("x") + moved * F.col("y")).alias("x"), "y").alias("p")), "v")
        r = at.groupBy("gnum").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("c"))
        return r.select("gnum", F.transform("c", lambda s: s["p"]).alias("ring"))

    got = overlay.overlay(rings(6, 7, 0.0), rings(9, 5, 0.0))
    assert math.isclose(got.agg(F.sum("measure")).first()[0], 1, rel_tol=1e-9)
    slanted = overlay.overlay(rings(6, 7, 0.0), rings(9, 5, 0.3))
    assert math.isclose(slanted.agg(F.sum("measure")).first()[0], 1 - 0.15, rel_tol=1e-9)


def test_domains(spark):
    a = spark.range(1, 4).withColumnRenamed("id", "gnum")
    same = spark.createDataFrame([(0, 3, 1, 1), (1, 3, 2, 1)], "block1 int, gnum1 long, block2 int, gnum2 long")
    new = {(r.block, r.gnum): r.new for r in domains.merge_blocks([a, a, a], same).collect()}
    assert new[0, 3] == new[1, 1] == 3 and new[1, 3] == new[2, 1] == 5 and sorted(set(new.values())) == list(range(1, 8))
    fv = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 20), (2, 1, 22), (2, 2, 21)], "face long, pos int, vtx long")
    pairs = domains.faces_to_vertices(spark.createDataFrame([(7, 1, 2)], "interface int, face1 long, face2 long"), fv)
    assert {(r.vtx1, r.vtx2) for r in pairs.collect()} == {(10, 20), (11, 21), (12, 22)}
    edges = spark.createDataFrame([(1, [10, 11]), (2, [21, 20]), (3, [12, 99])], "entity long, vtx array<long>")
    assert [tuple(r) for r in domains.vertices_to_entities(pairs, edges).collect()] == [(7, 1, 2)]
