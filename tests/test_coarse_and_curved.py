"""Agglomeration and the coarse mesh; location in warped and curved elements."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import shapes
from gridloom.operators import coarsening, connectivity, curved
from gridloom.sources import generators


def test_heavy_edges(spark):
    faces, cf = connectivity.descend(generators.cube_cells(spark, 6))
    graph = coarsening.cell_graph(cf).cache()
    cells = cf.select(F.col("src").alias("gnum")).distinct()
    edges = [(r.src, r.dst) for r in graph.collect()]
    for largest in (1, 2, 5, 8):
        got = {r.gnum: r.coarse for r in coarsening.COARSENINGS["heavy"](cells, graph, largest).collect()}
        sizes = Counter(got.values())
        assert set(got) == set(range(1, 126)) and set(sizes) == set(range(1, len(sizes) + 1)) and max(sizes.values()) <= largest
        near = defaultdict(set)
        for a, b in edges:
            if got[a] == got[b]:
                near[a].add(b)
                near[b].add(a)
        for g in sizes:  # groups hang together
            own = {c for c in got if got[c] == g}
            seen, todo = set(), [min(own)]
            while todo:
                c = todo.pop()
                if c not in seen:
                    seen.add(c)
                    todo += near[c]
            assert seen == own
        # maximal: no two groups that touch could still be one, of those of the last level
        assert not any(sizes[got[a]] == sizes[got[b]] == 1 and largest > 1 for a, b in edges)
    out = coarsening.coarse_mesh(spark.createDataFrame(list(got.items()), "gnum long, coarse long"), cf)
    fine = defaultdict(dict)
    for r in cf.collect():
        fine[abs(r.dst)][r.dst > 0] = got[r.src]
    named = {r.gnum: (r.c1, r.c2) for r in out["faces"].collect()}
    held = {r.face: r.coarse_face for r in out["face_map"].collect()}
    assert set(held) == {f for f, s in fine.items() if len(set(s.values())) == 2 or len(s) == 1}
    for f, c in held.items():
        c1, c2 = named[abs(c)]
        a, b = fine[f].get(True, 0), fine[f].get(False, 0)
        assert (a, b) == ((c1, c2) if c > 0 else (c2, c1)) and c1 > 0
    assert len(set(named.values())) == len(named)
    sides = Counter((r.src, r.dst) for r in out["cell_face"].collect())
    assert sides == Counter((c, g) for g, (c1, c2) in named.items() for c, g in ((c1, g), (c2, -g)) if c)


def test_weights_count(spark):
    """The heaviest edges pair first; cells without edges stay alone; odd edges count for nothing."""
    cells = spark.createDataFrame([(k,) for k in range(1, 8)], "gnum long")
    graph = spark.createDataFrame([(1, 2, 1.0), (2, 3, 5.0), (3, 4, 1.0), (5, 6, None), (5, 5, 9.0), (6, 99, 9.0)], "src long, dst long, weight double")
    got = {r.gnum: r.coarse for r in coarsening.heavy_edges(cells, graph, 2).collect()}
    assert got[2] == got[3] and len({got[1], got[2], got[4]}) == 3 and got[5] == got[6] and Counter(got.values())[got[7]] == 1
    assert coarsening.heavy_edges(cells.limit(0), graph, 2).count() == 0
    assert [r.coarse for r in coarsening.consecutive(cells, graph, 3).orderBy("gnum").collect()] == [1, 1, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("kind", sorted(shapes.CORNERS))
def test_shapes(kind):
    rng = np.random.default_rng(3)
    for order in (1, 2, 3) if kind != "pyramid" else (1,):
        s = shapes.shape(kind, order, "lattice" if kind != "pyramid" else "vtk")
        assert np.allclose(s.values(s.nodes)[0], np.eye(len(s.nodes)), atol=1e-9)
        x = rng.uniform(0, 1, (200, 3)) * (np.arange(3) < s.dim)
        x = x[s.inside(x, 0)]
        value, slope = s.values(x)
        assert np.allclose(value.sum(axis=1), 1) and np.allclose(value @ s.nodes, x)
        assert np.abs(value).sum(axis=1).max() <= s.reach
        for a in range(s.dim):
            e = np.eye(3)[a] * 1e-6
            assert np.allclose((s.values(x + e)[0] - s.values(x - e)[0]) / 2e-6, slope[:, :, a], atol=1e-4)


def warp(p):
    x, y, z = p.T
    return np.stack([x + 0.08 * np.sin(3 * y) * z, y + 0.07 * x * z + 0.03 * np.cos(4 * x), z + 0.09 * x * y - 0.05 * y * y], axis=1)


def test_warped_mesh(spark):
    """Elements of four types with faces that aren't planar: every point inside lies in one, and fields come out."""
    rng = np.random.default_rng(5)
    e = generators.cube_cells(spark, 5).select("gnum", F.lit("hexa").alias("elt_type"), "vtx")
    flat = {r.gnum: np.array([r.x, r.y, r.z]) for r in generators.cube_vertices(spark, 5).collect()}
    moved = {k: warp(p[None])[0] for k, p in flat.items()}
    v = spark.createDataFrame([(k, *map(float, p)) for k, p in moved.items()], "gnum long, x double, y double, z double")
    own = {r.gnum: r.vtx for r in e.collect()}
    s = shapes.shape("hexa", 1, "vtk")
    points, truth = [], {}
    for k in range(300):
        cell = int(rng.integers(1, 65))
        uvw = rng.uniform(0, 1, 3) if k % 3 else np.rint(rng.uniform(0, 1, 3) * 2) / 2  # on corners, edges and faces too
        n = s.values(uvw[None])[0][0]
        points.append((k, *map(float, n @ np.array([moved[x] for x in own[cell]]))))
        truth[k] = cell, uvw
    points += [(1000, 9.0, 9.0, 9.0), (1001, None, 0.0, 0.0), (1002, -0.5, 0.5, 0.5)]
    pdf = spark.createDataFrame(points, "gnum long, x double, y double, z double")
    got = {r.gnum: r for r in curved.locate(pdf, e, v).collect()}
    assert len(got) == len(points) and all(got[k].elt is None for k in (1000, 1001, 1002))
    for k, (cell, uvw) in truth.items():
        r = got[k]
        assert r.elt == cell or (r.elt < cell and not ((uvw > 1e-9) & (uvw < 1 - 1e-9)).all()), (k, r, cell, uvw)
        if r.elt == cell:
            assert np.allclose(r.uvw, uvw, atol=1e-8)
        assert np.allclose(sum(w * moved[x] for w, x in zip(r.weights, r.vtx, strict=True)), points[k][1:], atol=1e-10)
    found = {r.gnum: r for r in curved.interpolated(curved.locate(pdf, e, v), v.select("gnum", (2 * F.col("x") - F.col("y") + 3 * F.col("z") + 1).alias("f")), ["f"]).collect()}
    assert all(abs(found[k].f - (2 * points[k][1] - points[k][2] + 3 * points[k][3] + 1)) < 1e-9 for k in truth)


def test_curved_elements(spark):
    """Second-order tetrahedra and hexahedra with bent sides, an ordering of the user's, and a quadratic field."""
    rng = np.random.default_rng(6)
    for kind in ("tetra", "hexa", "prism"):
        nodes = shapes.lattice(kind, 2)
        order = rng.permutation(len(nodes))
        shapes.register_ordering("mine", kind, 2, [nodes[k] for k in order])
        s = shapes.shape(kind, 2, "mine")
        bent = warp(s.nodes) + rng.uniform(-0.02, 0.02, s.nodes.shape)
        v = spark.createDataFrame([(k + 1, *map(float, p)) for k, p in enumerate(bent)], "gnum long, x double, y double, z double")
        e = spark.createDataFrame([(1, kind, list(range(1, len(nodes) + 1))), (2, kind, [1, 2])], "gnum long, elt_type string, vtx array<long>")
        uvw = rng.uniform(0, 1, (200, 3))
        uvw = uvw[s.inside(uvw, 0)]
        p = s.values(uvw)[0] @ bent
        got = {r.gnum: r for r in curved.locate(spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "gnum long, x double, y double, z double"), e, v, 2, "mine").collect()}
        assert all(got[k].elt == 1 and np.allclose(got[k].uvw, x, atol=1e-7) for k, x in enumerate(uvw))
        f = lambda u: 1 + u[:, 0] - 2 * u[:, 1] * u[:, 2] + u[:, 0] ** 2  # noqa: E731  quadratic in the reference element
        assert np.allclose([np.dot(got[k].weights, f(s.nodes)) for k in range(len(uvw))], f(uvw), atol=1e-6)
    with pytest.raises(ValueError):
        shapes.register_ordering("bad", "tetra", 2, [(0, 0, 0)])


def test_groups_carry_their_sizes(spark):
    """A matching from edges that are one row each and carry the sizes of their ends; groups as a plain loop makes them."""
    rng = np.random.default_rng(12)
    weights = {(int(a), int(b)): float(w) for w, (a, b) in zip(rng.uniform(1, 2, 160), rng.integers(0, 50, (160, 2)), strict=True) if a < b}

    def matched(edges):
        pairs, free = [], {k for e in edges for k in e}
        for a, b in sorted(edges, key=edges.get, reverse=True):  # as weights differ, rounds of mutual wishes give the greedy matching
            if a in free and b in free:
                pairs.append((a, b))
                free -= {a, b}
        return sorted(pairs)

    rows = spark.createDataFrame([(a, b, w, a + 1, b + 1) for (a, b), w in weights.items()], "a long, b long, weight double, sa long, sb long")
    assert sorted(tuple(r) for r in coarsening.pairs_of(rows).collect()) == [(a, b, a + 1, b + 1) for a, b in matched(weights)]
    assert coarsening.pairs_of(rows.where("false")) is None
    group, size, edges = {k: k for k in range(52)}, dict.fromkeys(range(52), 1), dict(weights)
    while pairs := matched({e: w for e, w in edges.items() if size[e[0]] + size[e[1]] <= 5}):
        into = {b: a for a, b in pairs}
        for a, b in pairs:
            size[a] += size.pop(b)
        group, moved = {k: into.get(g, g) for k, g in group.items()}, {}
        for (a, b), w in edges.items():
            a, b = sorted((into.get(a, a), into.get(b, b)))
            if a != b:
                moved[a, b] = moved.get((a, b), 0) + w
        edges = moved
    cells = spark.range(52).withColumnRenamed("id", "gnum")
    graph = spark.createDataFrame([(b, a, w) if a % 2 else (a, b, w) for (a, b), w in weights.items()] + [(3, 3, 900.0), (3, 99, 900.0)], "src long, dst long, weight double")
    got = {}
    for r in coarsening.heavy_edges(cells, graph, 5).collect():
        got.setdefault(r.coarse, set()).add(r.gnum)
    want = {}
    for k, g in group.items():
        want.setdefault(g, set()).add(k)
    assert max(map(len, got.values())) <= 5 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
