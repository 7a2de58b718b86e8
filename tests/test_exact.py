"""Signs of the exact predicates against fractions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import exact, geometry as G


def sign(x):
    return (x > 0) - (x < 0)


def det(m):
    if len(m) == 1:
        return m[0][0]
    return sum((-1) ** k * m[0][k] * det([row[:k] + row[k + 1 :] for row in m[1:]]) for k in range(len(m)))


def lifted(points, axes, lift):
    p = [[Fraction(float(v)) for v in q[:axes]] for q in points]
    rows = [[a - b for a, b in zip(q, p[-1], strict=True)] for q in p[:-1]]
    return det([[*r, sum(x * x for x in r)] if lift else r for r in rows])


WANT = {
    "orient2d_sign": lambda q: sign(lifted(q[:3], 2, False)),
    "orient3d_sign": lambda q: sign(lifted(q[:4], 3, False)),
    "in_circle_sign": lambda q: sign(lifted(q[:4], 2, True)),
    # the lifted determinant is negative inside where the first four are ordered as orient3d_sign 1
    "in_sphere_sign": lambda q: sign(lifted(q[:5], 3, True)),
}
POINTS = {"orient2d_sign": 3, "orient3d_sign": 4, "in_circle_sign": 4, "in_sphere_sign": 5}


def near_degenerate(name, n, vectors):
    """Points on a line, plane, circle or sphere up to a few units of rounding."""
    rng, out = np.random.default_rng(11), []
    for i in range(n):
        v = np.asarray(vectors[i % len(vectors)], np.float64)
        p = v[:15].reshape(5, 3).copy()
        if name == "orient2d_sign":
            t = v[20]
            p[2] = p[0] + t * (p[1] - p[0])
        elif name == "orient3d_sign":
            p[3] = p[0] + v[20] * (p[1] - p[0]) + v[21] * (p[2] - p[0])
        else:
            last = POINTS[name] - 1
            c, r = v[30:33], abs(v[33]) + 0.01
            for k in range(last + 1):
                d = rng.normal(size=3)
                d[2] *= name == "in_sphere_sign"
                p[k] = c + r * d / np.linalg.norm(d)
            if name == "in_circle_sign":
                p[:, 2] = 0
        for _ in range(rng.integers(0, 3)):
            a, b = rng.integers(0, POINTS[name]), rng.integers(0, 2)
            p[a, b] = np.nextafter(p[a, b], rng.choice([-1, 1]))
        if i % 7 == 0:
            p[1] = p[0]
        out.append(p)
    return out


@pytest.mark.parametrize(("name", "n"), [("orient2d_sign", 10_000), ("orient3d_sign", 3_000), ("in_circle_sign", 3_000), ("in_sphere_sign", 1_000)])
def test_signs(spark, name, n):
    vectors = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows = near_degenerate(name, n, vectors)
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(rows)], "i long, v array<double>").repartition(8)
    q = [G.point(*[F.get("v", F.lit(3 * k + a)) for a in range(3)]) for k in range(POINTS[name])]
    got = dict(df.select("i", getattr(exact, name)(*q).alias("s")).collect())
    want = {i: WANT[name](p) for i, p in enumerate(rows)}
    assert got == want
    assert len(set(want.values())) == 3  # all three signs are there


def test_signs_of_odd_values(spark):
    rows = [(0, [0.0, 0.0, 1.0, 0.0, None, 1.0]), (1, [0.0, 0.0, 1.0, 0.0, float("nan"), 1.0]), (2, [0.0, 0.0, 1.0, 0.0, float("inf"), 1.0]), (3, [0.0] * 6), (4, [1e-40, 0.0, 1e40, 1.0, 0.0, 1e-40])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    q = [F.struct(F.get("v", F.lit(2 * k)).alias("x"), F.get("v", F.lit(2 * k + 1)).alias("y")) for k in range(3)]
    got = dict(df.select("i", exact.orient2d_sign(*q)).collect())
    p = [Fraction(x) for x in rows[4][1]]
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: sign((p[0] - p[4]) * (p[3] - p[5]) - (p[1] - p[5]) * (p[2] - p[4]))}
