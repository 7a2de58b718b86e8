"""Merged blocks with data, views of interfaces, extraction of partitioned meshes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import domains, extraction, partition, periodic, spatial

PAIR = "block1 int, gnum1 long, block2 int, gnum2 long"
FACE = "interface int, domain1 int, gnum1 long, domain2 int, gnum2 long"


def sets(nodes, pairs):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_merged_blocks_have_their_data(spark):
    rng = random.Random(4)
    nodes = [(b, g) for b in range(3) for g in range(1, 41)]
    pairs = [(*rng.choice(nodes), *rng.choice(nodes)) for _ in range(40)] + [(0, 1, 2, 999)]
    blocks = [spark.createDataFrame([(g, f"{b}-{g}") for b, g in nodes if b == k], "gnum long, value string") for k in range(3)]
    numbers = domains.merge_blocks(blocks, spark.createDataFrame(pairs, PAIR))
    root = sets(nodes, [(p[:2], p[2:]) for p in pairs])
    order = {r: k + 1 for k, r in enumerate(sorted(set(root.values())))}
    new = {n: order[root[n]] for n in nodes}
    assert {(r["block"], r["gnum"]): r["new"] for r in numbers.collect()} == new
    assert {r["gnum"]: r["value"] for r in domains.merge_data(blocks, numbers).collect()} == {k: f"{b}-{g}" for (b, g), k in order.items()}
    conns = [spark.createDataFrame([(g, p, rng.choice((-1, 1)) * rng.randint(1, 40)) for b, g in nodes if b == k for p in range(2)], "src long, pos int, dst long") for k in range(3)]
    want = {(order[(k, r["src"])], r["pos"], new[k, abs(r["dst"])] * (1 if r["dst"] > 0 else -1)) for k, c in enumerate(conns) for r in c.collect() if (k, r["src"]) in order}
    assert {tuple(r) for r in domains.merge_connectivity(conns, numbers, numbers).collect()} == want
    got = domains.ancestors(numbers).collect()
    for k in order.values():
        assert [(r["block"], r["gnum"]) for r in sorted((r for r in got if r["new"] == k), key=lambda r: r["pos"])] == sorted(n for n in nodes if new[n] == k)


def test_views_of_interfaces(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randint(1, 3), rng.randint(0, 2), rng.randint(1, 9), rng.randint(0, 2), rng.randint(1, 9)) for _ in range(25)})
    df = spark.createDataFrame(pairs, FACE)
    nodes = {p[1:3] for p in pairs} | {p[3:] for p in pairs}
    root = sets(nodes, [(p[1:3], p[3:]) for p in pairs])
    order = {r: k + 1 for k, r in enumerate(sorted(set(root.values())))}
    assert {(r["domain"], r["gnum"]): r["graph"] for r in domains.as_graph(df).collect()} == {n: order[root[n]] for n in nodes}
    near = {}
    for i, d1, g1, d2, g2 in pairs:
        near.setdefault((d1, g1), set()).add((i, d2, g2))
        near.setdefault((d2, g2), set()).add((-i, d1, g1))
    want = {(d, g, k, *x) for (d, g), xs in near.items() for k, x in enumerate(sorted(xs))}
    assert {tuple(r) for r in domains.flat_view(df).collect()} == want


def test_a_sector_turned_onto_the_next(spark):
    angle, axis, center = 0.7, (1.0, 2.0, -1.0), (0.3, -0.2, 0.5)
    t = periodic.turn(center, axis, angle)
    assert math.dist(periodic.turn((0, 0, 0), (0, 0, 5), math.pi / 2), (0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0)) < 1e-12
    points = spark.createDataFrame([(k, math.sin(k), math.cos(k), k / 5) for k in range(1, 9)], "gnum long, x double, y double, z double")
    moved = domains.place(points, t)
    back = {r["gnum"]: (r["x"], r["y"], r["z"]) for r in domains.place(moved, periodic.inverse(t)).collect()}
    assert all(math.dist(back[r["gnum"]], (r["x"], r["y"], r["z"])) < 1e-12 for r in points.collect())
    assert {r["gnum"]: round(math.dist((r["x"], r["y"], r["z"]), center), 9) for r in moved.collect()} == {r["gnum"]: round(math.dist((r["x"], r["y"], r["z"]), center), 9) for r in points.collect()}
    both = points.select(F.lit(0).alias("domain"), "*").union(moved.select(F.lit(1), "*"))
    pairs = spark.createDataFrame([(i, 0, k, 1, k) for k in range(1, 9) for i in (1, 2)], FACE)
    got = {r["interface"]: r for r in domains.gaps(pairs, both, {1: t}).collect()}
    assert got[1]["pairs"] == 8 and got[1]["worst"] < 1e-12 < 0.1 < got[2]["worst"]
    with pytest.raises(ValueError):
        periodic.turn(center, (0, 0, 0), 1.0)


def strip(spark, n=24, parts=4):
    """A closed row of n cells: cell c between faces c and c % n + 1, each with three vertices of its own and a shared one."""
    cf = [(c, 0, c) for c in range(1, n + 1)] + [(c, 1, -(c % n + 1)) for c in range(1, n + 1)]
    fv = [(f, k, 2 * f + k) for f in range(1, n + 1) for k in range(4)]
    split = [(c, (c * 7) % parts) for c in range(1, n + 1)]
    groups = [("face", f % 3, f) for f in range(1, n + 1)]
    long = "src long, pos int, dst long"
    return cf, fv, partition.partition_mesh(spark.createDataFrame(split, "gnum long, part int"), spark.createDataFrame(cf, long), spark.createDataFrame(fv, long), spark.createDataFrame(groups, "kind string, group int, gnum long"))


def whole(out):
    """Checks numbers and parents of an extraction and gives its connectivities by part in old ids."""
    names = {n: {(r["part"], r["lnum"]): r["parent"] for r in out[n].collect()} for n in extraction.LEVELS}
    for n in extraction.LEVELS:
        rows = out[n].collect()
        old = {r["gnum"]: r["parent"] for r in rows}
        assert sorted(old) == list(range(1, len(old) + 1)) and [old[k] for k in sorted(old)] == sorted(old.values())
    sign = lambda x: 1 if x > 0 else -1
    cf = {(r["part"], names["cells"][r["part"], r["src"]], r["pos"], sign(r["dst"]) * names["faces"][r["part"], abs(r["dst"])]) for r in out["cell_face"].collect()}
    fv = {(r["part"], names["faces"][r["part"], r["src"]], r["pos"], names["vertices"][r["part"], r["dst"]]) for r in out["face_vtx"].collect()}
    return names, cf, fv


@pytest.mark.parametrize("how", ["stay", "even", "curve", "target"])
def test_extracted_parts(spark, how):
    cf, fv, mesh = strip(spark)
    at = {(r["part"], r["lnum"]): r["gnum"] for r in mesh["cells"].collect()}
    picked = [k for k in at if at[k] % 5 != 0]
    chosen = spark.createDataFrame([*picked, picked[0], (0, 999)], "part int, lnum int")
    cells = sorted(at[k] for k in picked)
    if how == "stay":
        out, want = extraction.extract_parts(mesh, chosen), {(k[0], at[k]) for k in picked}
    elif how == "even":
        out = extraction.extract_parts(mesh, chosen, 3)
        want = {(min(i // (-(-len(cells) // 3)), 2), c) for i, c in enumerate(cells)} if len(cells) % 3 == 0 else None
    elif how == "curve":
        centers = spark.createDataFrame([(c, math.cos(c), math.sin(c), 0.0) for c in at.values()], "gnum long, x double, y double, z double")
        out, want = extraction.extract_parts(mesh, chosen, 3, centers), None
    else:
        asked = [(c % 2, c) for c in cells] + [(5, c) for c in cells[:4]]
        out, want = extraction.extract_parts(mesh, target=spark.createDataFrame([*asked, asked[0], (1, 999)], "part int, gnum long")), set(asked)
    names, got_cf, got_fv = whole(out)
    held = {(k[0], c) for k, c in names["cells"].items()}
    if want is not None:
        assert held == want
    assert sorted({c for _, c in held}) == cells
    sizes = [sum(p == q for q, _ in held) for p in {p for p, _ in held}]
    assert how in ("stay", "target") or max(sizes) - min(sizes) <= 1
    assert got_cf == {(p, *r) for p, c in held for r in cf if r[0] == c}
    faces = {(p, abs(r[2])) for p, c in held for r in cf if r[0] == c}
    assert got_fv == {(p, *r) for p, f in faces for r in fv if r[0] == f}
    assert {(r["part"], names["faces"][r["part"], r["lnum"]], r["group"]) for r in out["groups"].collect()} == {(p, f, f % 3) for p, f in faces}
    first = {}
    for r in mesh["vertices"].collect():
        first[r["gnum"]] = min(first.get(r["gnum"], (99, 99)), (r["part"], r["lnum"]))
    assert all((r["from_part"], r["from_lnum"]) == first[r["parent"]] for r in out["vertices"].collect())


def test_extraction_of_nothing(spark):
    _, _, mesh = strip(spark)
    none = spark.createDataFrame([], "part int, lnum int")
    for more in ({}, {"parts": 2}):
        out = extraction.extract_parts(mesh, none, **more)
        assert all(out[n].count() == 0 for n in (*extraction.LEVELS, "cell_face", "face_vtx", "groups"))
    with pytest.raises(ValueError):
        extraction.extract_parts(mesh)


def test_extraction_makes_what_is_read(spark):
    """Faces of cells never read the vertices; without the ids that partition_mesh gives along, local numbers tell the same."""
    cf, _, mesh = strip(spark)
    long = "src long, pos int, dst long"
    bad = spark.createDataFrame([(1, 0, 1)], long).withColumn("dst", F.raise_error(F.concat(F.lit("read "), F.col("src").cast("string"))).cast("long"))
    split = mesh["cells"].select("gnum", "part")
    asked = spark.createDataFrame([(0, 3), (0, 4), (1, 4)], "part int, gnum long")
    want = sorted(map(tuple, extraction.extract_parts(mesh, target=asked)["cell_face"].collect()))
    out = extraction.extract_parts(partition.partition_mesh(split, spark.createDataFrame(cf, long), bad), target=asked)
    assert sorted(map(tuple, out["cell_face"].collect())) == want and len(want) == 6
    plain = {k: v for k, v in mesh.items() if not k.endswith("_ids")}
    again = extraction.extract_parts(plain, target=asked)
    assert sorted(map(tuple, again["cell_face"].collect())) == want
    ids = {r.lnum + 100 * r.part: r.gnum for r in again["cells"].collect()}
    faces = {r.lnum + 100 * r.part: r.gnum for r in again["faces"].collect()}
    sign = lambda x: 1 if x > 0 else -1
    assert {tuple(r) for r in again["cell_face_ids"].collect()} == {(ids[s + 100 * p], k, sign(d) * faces[abs(d) + 100 * p]) for p, s, k, d in want}


def test_ids_of_points_within_a_tolerance(spark):
    rng = random.Random(6)
    at = {k: tuple(rng.random() for _ in range(3)) for k in range(1, 41)}
    for k in range(41, 61):  # beside another, some in chains
        x = at[rng.randint(1, k - 1)]
        at[k] = (x[0] + 0.9e-6, x[1], x[2])
    rows = [(k, *p) for k, p in at.items()] + [(99, None, 0.0, 0.0)]
    out = spatial.coincident_ids(spark.createDataFrame(rows, "gnum long, x double, y double, z double"), 1e-6)
    got = {r["gnum"]: r["new"] for r in out.collect()}
    root = sets(at, [(a, b) for a in at for b in at if a < b and math.dist(at[a], at[b]) <= 1e-6])
    assert got.pop(99) is None and set(got.values()) == set(range(1, len(set(root.values())) + 1))
    assert all((got[a] == got[b]) == (root[a] == root[b]) for a in at for b in at)
    none = spark.createDataFrame([], "gnum long, x double, y double, z double")
    assert spatial.coincident_ids(none, 1e-6).count() == 0
