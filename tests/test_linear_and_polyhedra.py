"""Dense systems against numpy, mean value coordinates by their defining properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import connectivity, linear, polyhedra
from gridloom.sources import generators

rng = np.random.default_rng(12)


def frame(spark, rows, right=True):
    return spark.createDataFrame(rows, "gnum long, a array<double>" + (", b array<double>" if right else "")).repartition(4)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_solve(spark, n):
    a, b = rng.normal(size=(60, n, n)), rng.normal(size=(60, n))
    for k in range(0, 60, 6):  # pivots of zero in the first place
        a[k, 0, 0] = 0 if n > 1 else 1
    if n > 1:
        a[7, :, -1] = 2 * a[7, :, 0]
        a[8] = 0
        a[9, 1] = a[9, 0] * 3
    rows = [(k, a[k].ravel().tolist(), b[k].tolist()) for k in range(60)] + [(100, None, [1.0] * n), (101, [1.0] * (n * n + 1), [1.0] * n), (102, [float("nan")] * (n * n), [1.0] * n), (103, [1.0] * (n * n), [None] * n)]
    got = {r.gnum: r for r in linear.solve(frame(spark, rows), n).collect()}
    assert all(got[k].x is None and got[k].rank is None for k in (100, 101, 102, 103))
    for k in range(60):
        rank = np.linalg.matrix_rank(a[k], tol=1e-10)
        assert got[k].rank == rank
        assert (got[k].x is None) == (rank < n)
        if rank == n:
            assert np.allclose(got[k].x, np.linalg.solve(a[k], b[k]), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize(("m", "n"), [(3, 3), (6, 3), (2, 4), (5, 1)])
def test_singular_values_and_least_squares(spark, m, n):
    a, b = rng.normal(size=(40, m, n)), rng.normal(size=(40, m))
    a[3] = 0
    if n > 1:
        a[4, :, 1] = a[4, :, 0]
        a[5] = np.outer(rng.normal(size=m), rng.normal(size=n)) * 1e6
    rows = [(k, a[k].ravel().tolist(), b[k].tolist()) for k in range(40)] + [(100, None, None)]
    svd = {r.gnum: r for r in linear.singular_values(frame(spark, rows).drop("b"), m, n).collect()}
    fit = {r.gnum: r for r in linear.least_squares(frame(spark, rows), m, n).collect()}
    assert svd[100].s is None and fit[100].x is None
    for k in range(40):
        u, s, v = np.array(svd[k].u).reshape(m, n), np.array(svd[k].s), np.array(svd[k].v).reshape(n, n)
        want = np.linalg.svd(a[k], compute_uv=False)
        top = max(want.max(), 1e-300)
        assert np.allclose(s[: len(want)] / top, want / top, atol=1e-10) and np.all(s[len(want) :] <= 1e-9 * top)
        assert np.allclose(u * s @ v.T, a[k], atol=1e-9 * max(1, top)) and np.allclose(v.T @ v, np.eye(n), atol=1e-10)
        x, _, rank, _ = np.linalg.lstsq(a[k], b[k], rcond=1e-12)
        assert fit[k].rank == rank and np.allclose(fit[k].x, x, rtol=1e-6, atol=1e-8)
        assert abs(fit[k].residual - np.linalg.norm(a[k] @ x - b[k])) < 1e-7


def test_mean_values(spark):
    """Partition of unity and linear precision in general elements and in a shape that isn't convex, at points inside, on
    faces, edges and vertices."""
    v = generators.cube_vertices(spark, 3, 2.0)
    e = generators.cube_mixed(spark, 3)
    faces, signed = connectivity.descend(e)
    t = polyhedra.face_triangles(signed, faces)
    own = {r.gnum: r.vtx for r in e.collect()}
    at = {r.gnum: np.array([r.x, r.y, r.z]) for r in v.collect()}
    pairs = []
    for cell, vtx in own.items():
        p = [at[x] for x in vtx]
        for w in (rng.dirichlet(np.ones(len(p)), 3).tolist(), [[1.0] + [0.0] * (len(p) - 1)], [[0.5, 0.5] + [0.0] * (len(p) - 2)], [[0.3, 0.3, 0.4] + [0.0] * (len(p) - 3)]):
            pairs += [(len(pairs) + k, cell, *map(float, np.array(x) @ np.array(p))) for k, x in enumerate(w)]
    df = spark.createDataFrame(pairs, "gnum long, cell long, x double, y double, z double")
    w = polyhedra.mean_value_weights(df.unionByName(df.limit(1).select(F.lit(-1).cast("long").alias("gnum"), "cell", F.lit(None).cast("double").alias("x"), "y", "z")), t, v)
    got = {}
    for r in w.collect():
        got.setdefault((r.gnum, r.cell), {})[r.v] = r.weight
    assert len(got) == len(pairs)
    for g, cell, *x in pairs:
        weights = got[g, cell]
        assert abs(sum(weights.values()) - 1) < 1e-12 and min(weights.values()) > -1e-9 and set(weights) <= set(own[cell])
        assert np.allclose(sum(k * at[i] for i, k in weights.items()), x, atol=1e-9)
    spots = polyhedra.interpolated(w, v, ["x", "y", "z"]).collect()
    assert len(spots) == len(pairs)


def test_mean_values_outside_and_not_convex(spark):
    """An L of three cubes as one polyhedron: linear precision inside and out."""
    corner = [(x, y) for x, y in ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))]
    vs = [(k + 1, float(x), float(y), float(z)) for k, (x, y, z) in enumerate([(x, y, z) for z in (0, 1) for x, y in corner])]
    tri = [(1, 2, 3), (1, 3, 4), (1, 4, 6), (4, 5, 6)]
    out = [(1, a, c, b) for a, b, c in tri] + [(1, a + 6, b + 6, c + 6) for a, b, c in tri]
    for k in range(6):
        a, b = k + 1, (k + 1) % 6 + 1
        out += [(1, a, b, b + 6), (1, a, b + 6, a + 6)]
    pairs = [(k, 1, *map(float, p)) for k, p in enumerate(np.vstack([rng.uniform(0.05, 0.95, (10, 3)), rng.uniform(-1, 3, (10, 3)), [[1.5, 0.5, 0.5], [1, 1, 0.5], [0.5, 0.5, 0]]]))]
    w = polyhedra.mean_value_weights(spark.createDataFrame(pairs, "gnum long, cell long, x double, y double, z double"), spark.createDataFrame(out, "cell long, v1 long, v2 long, v3 long"), spark.createDataFrame(vs, "gnum long, x double, y double, z double"))
    for r in polyhedra.interpolated(w, spark.createDataFrame(vs, "gnum long, x double, y double, z double"), ["x", "y", "z"]).collect():
        assert np.allclose([r.x, r.y, r.z], pairs[r.gnum][2:], atol=1e-8)


def test_mean_values_close_to_faces_and_edges():
    """Linear precision to rounding at any distance from a face and an edge of a cube, and in a flat parallelepiped."""
    cube = np.array([[x, y, z] for z in (0, 1) for y in (0, 1) for x in (0, 1)], float)
    tri = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]

    def found(x, at):
        kind, w = polyhedra.shares(np.repeat(x[None], len(tri), 0), np.array([at[list(t)] for t in tri]))
        out = np.zeros(len(at))
        for t, k, s in zip(tri, kind, w, strict=True):
            if k == kind.min():
                out[list(t)] += s
        return out / out.sum()

    for y in (0, 1e-15, 1e-12, 1e-10, 8.891604484832994e-07, 1e-4):
        for z in (0, 1e-13, 1e-9, 1e-6, 0.1543275760784665):
            x = np.array([0.0428274020799688, y, z])
            w = found(x, cube)
            assert np.abs(w @ cube - x).max() <= 2e-12 and w.min() > -1e-9
    for thin in (1e-3, 1e-6):
        at = cube @ np.array([[0.1, 0.02, 0], [0.03, 0.2, 0.01], [0.13, 0.22, 0.01 + thin]])
        x = at[0] + 0.4 * (at[1] - at[0]) + 0.2 * (at[2] - at[0]) + 0.2 * (at[4] - at[0])
        assert np.abs(found(x, at) @ at - x).max() < 1e-13
