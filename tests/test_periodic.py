"""Ghost layers over periodic interfaces and several domains, against unrolled meshes."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import periodic


def layers(cells, corners, depth):
    """Breadth first over shared corners: cells: {id: part}, corners: {id: set}. {(part, id): layer}."""
    at = defaultdict(set)
    for c, vs in corners.items():
        for v in vs:
            at[v].add(c)
    out = {}
    for part in set(cells.values()) - {None}:
        front = {c for c, p in cells.items() if p == part}
        seen = dict.fromkeys(front, 0)
        for k in range(1, depth + 1):
            front = {d for c in front for v in corners[c] for d in at[v]} - set(seen)
            seen.update(dict.fromkeys(front, k))
        out.update({(part, c): k for c, k in seen.items()})
    return out


def run(spark, cells, conn, pairs, transforms, depth):
    c = spark.createDataFrame(cells, "part int, domain int, gnum long")
    k = spark.createDataFrame(conn, "domain int, src long, dst long")
    i = spark.createDataFrame(pairs, "interface int, domain1 int, gnum1 long, domain2 int, gnum2 long")
    rows = periodic.ghost_layers(c, k, i, transforms, depth).collect()
    assert len(rows) == len({(r.part, r.domain, r.gnum, tuple(round(x, 6) for x in r.transform)) for r in rows})
    return rows


@pytest.mark.parametrize(("both", "depth"), [(False, 2), (True, 2), (True, 3)])
def test_periodic_grid(spark, both, depth):
    """Squares of a grid, periodic in x, or in x and y: corners have images over both and over their composition."""
    nx, ny = 4, 3
    vertex = lambda i, j: 1 + i + j * (nx + 1)
    cell = lambda i, j: 1 + i + j * nx
    around = lambda i, j: [(i + a, j + b) for a in (0, 1) for b in (0, 1)]
    conn = [(0, cell(i, j), vertex(*v)) for i in range(nx) for j in range(ny) for v in around(i, j)]
    part = {(i, j): (i + j * nx) // 5 for i in range(nx) for j in range(ny)}
    pairs = [(1, 0, vertex(0, j), 0, vertex(nx, j)) for j in range(ny + 1)]
    if both:
        pairs += [(2, 0, vertex(i, 0), 0, vertex(i, ny)) for i in range(nx + 1)]
    got = run(spark, [(p, 0, cell(*c)) for c, p in part.items()], conn, pairs + pairs[:2], {1: periodic.translation(nx), 2: periodic.translation(0, ny)}, depth)
    reach = range(-2, 3)
    copies = [(i, j, a, b) for i in range(nx) for j in range(ny) for a in reach for b in (reach if both else [0])]
    # from each part of the middle copy alone
    want = layers({(i, j, a, b): part[i, j] if a == b == 0 else None for i, j, a, b in copies}, {(i, j, a, b): set(around(i + a * nx, j + b * ny)) for i, j, a, b in copies}, depth)
    assert {(r.part, r.gnum, round(r.transform[3]), round(r.transform[7])): r.layer for r in got} == {(p, cell(i, j), a * nx, b * ny): k for (p, (i, j, a, b)), k in want.items()}


def test_two_domains_and_a_translation(spark):
    """Two rows of cells, the second one's frame shifted: the ghosts of one domain's part lie in the other."""
    conn = [(d, k, v) for d in (0, 1) for k in range(1, 6) for v in (k, k + 1)]
    cells = [(d, d, k) for d in (0, 1) for k in range(1, 6)]
    got = run(spark, cells, conn, [(7, 0, 6, 1, 1)], {7: periodic.translation(0, 100)}, 2)
    ghosts = {(r.part, r.domain, r.gnum, r.layer, round(r.transform[7])) for r in got if r.layer}
    assert ghosts == {(0, 1, 1, 1, -100), (0, 1, 2, 2, -100), (1, 0, 5, 1, 100), (1, 0, 4, 2, 100)}


def test_turns_that_close(spark):
    """A sector of a quarter turn: three steps one way are one step the other way, so a cell is a ghost three times."""
    a = math.pi / 2
    turn = periodic.rotation([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    # one cell between the sides (vertices 1 and 2); the axis is vertex 3
    got = run(spark, [(0, 0, 1)], [(0, 1, 1), (0, 1, 2), (0, 1, 3)], [(1, 0, 1, 0, 2), (1, 0, 3, 0, 3)], {1: turn}, 1)
    assert sorted(r.layer for r in got) == [0, 1, 1, 1]
    got = run(spark, [(0, 0, 1)], [(0, 1, 1), (0, 1, 2)], [(1, 0, 1, 0, 2)], {1: turn}, 2)
    assert sorted(r.layer for r in got) == [0, 1, 1, 2]


def test_inverse_and_empty(spark):
    t = periodic.rotation([[0, -1, 0], [1, 0, 0], [0, 0, 1]], (1, 2, 3))
    apply = lambda m, p: [sum(m[4 * r + k] * p[k] for k in range(3)) + m[4 * r + 3] for r in range(3)]
    assert apply(periodic.inverse(t), apply(t, [5.0, 6.0, 7.0])) == [5.0, 6.0, 7.0] and apply(t, [1.0, 2.0, 9.0]) == [1.0, 2.0, 9.0]
    assert run(spark, [], [(0, 1, 1)], [], {}, 2) == []
    assert [r.layer for r in run(spark, [(0, 0, 1)], [(0, 1, 1)], [(1, 5, 9, 6, 9)], {1: t}, 2)] == [0]


def test_moves_are_numbered_once(spark):
    """What rows carry is a number: the same for equal compositions, whose transform is kept once."""
    lit = lambda t: F.array(*[F.lit(float(v)) for v in t])
    row = lambda name, key, t: spark.range(1).select(key.alias(name), lit(t).alias("step" if name == "sid" else "transform"))
    start = [row("move", periodic.named_by(lit(t)), t) for t in (periodic.IDENTITY, periodic.translation(2.0))]
    steps = row("sid", F.lit(7).cast("long"), periodic.translation(1.0)).unionByName(row("sid", F.lit(8).cast("long"), periodic.translation(2.0)))
    moves = start[0].unionByName(start[1])
    found, after = periodic.moved_on(moves, steps, moves.select("move").crossJoin(steps.select("sid")))
    shift = {r.move: round(r.transform[3], 6) for r in found.collect()}
    assert sorted(shift.values()) == [0, 1, 2, 3, 4]
    assert sorted((shift[r.move], r.sid, shift[r.to]) for r in after.collect()) == [(0, 7, 1), (0, 8, 2), (2, 7, 3), (2, 8, 4)]
