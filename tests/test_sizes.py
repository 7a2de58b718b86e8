"""What must not grow with the input: broadcasts, and shuffles of the same rows."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.tables import materialise, numbered
from gridloom.operators import connectivity, intersection, spatial
from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_tables_are_not_broadcast(spark):
    """Ranges and packed files look small to the planner, however much their arrays explode to."""
    cells = plan_of(QUERIES["cube_cells"](spark, SF))
    assert "BroadcastHashJoin [v#" not in cells and "SortMergeJoin [v#" in cells
    wide = materialise(spark.range(1000).select("id", F.array_repeat("id", 50).alias("v")))
    met = wide.select(F.explode("v").alias("id")).join(spark.range(10**7).withColumn("x", F.col("id") % 3), "id")
    assert "Broadcast" not in plan_of(met) and met.count() == 50_000


def test_numbers_move_rows_once(spark):
    """Without groups, numbered rows are not shuffled after the range sort; with them once, and groups may begin and end
    anywhere, also with nulls."""
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") % 11).cast("string")).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("h"))
    flat = numbered(df, ["k"])
    assert "SortMergeJoin" not in plan_of(flat) and [r.gnum for r in flat.orderBy("k").collect()] == list(range(1, 5001))
    held = {}
    by_group = numbered(df, ["k"], "pos", ["g", "h"])
    assert "SortMergeJoin" not in plan_of(by_group)
    for r in by_group.collect():
        held.setdefault((r.g, r.h), []).append((r.k, r.pos))
    assert len(held) == 44 and all([p for _, p in sorted(x)] == list(range(1, len(x) + 1)) for x in held.values())
    assert not numbered(df.where("false"), ["k"], "n", ["g"]).count() and not numbered(df.where("false"), ["k"]).count()


def test_combined_as_arrays(spark):
    """Pairs are shuffled as arrays, no row a pair; sources and shared entities above the length of one array too."""
    ab = spark.range(600).select((F.col("id") % 40).alias("src"), F.lit(0).alias("pos"), (F.col("id") * 7 % 90 + 1).alias("dst"))
    bc = spark.range(900).select((F.col("id") % 91 + 1).alias("src"), F.lit(0).alias("pos"), (-(F.col("id") * 13 % 200 + 1)).alias("dst"))
    want = {}
    right = [(r.src, abs(r.dst)) for r in bc.collect()]
    for r in ab.collect():
        want.setdefault(r.src, set()).update(c for b, c in right if b == r.dst)
    rows = [(a, c, k + 1) for a, cs in want.items() for k, c in enumerate(sorted(cs))]
    for most in (connectivity.LIST, 7):
        assert sorted(tuple(r) for r in connectivity.combine(ab, bc, most).select("src", "dst", "pos").collect()) == sorted(rows)
    assert sorted(tuple(r) for r in connectivity.combine_pairs(ab, bc).collect()) == sorted((a, c) for a, c, _ in rows)


def test_sets_are_not_rows(spark):
    found = connectivity.combined_lists(spark.range(100).select((F.col("id") % 5).alias("src"), F.col("id").alias("dst")), spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert found.count() == 5 and found.where("whole AND size(dsts) = 20").count() == 5


def test_blocks_have_each_pair_once(spark):
    """Boxes of all sizes, many of them in one place, in blocks of a few rows: every pair once, with both sides' data."""
    rng = np.random.default_rng(31)

    def side(n):
        low = np.where(rng.random((n, 1)) < 0.4, rng.uniform(0, 0.01, (n, 3)), rng.uniform(0, 4, (n, 3)))
        high = low + 10.0 ** rng.uniform(-4, 0.5, (n, 3))
        return [(g, [float(g)] * (g % 3 + 1), *np.stack([low[g], high[g]], 1).ravel().tolist()) for g in range(n)]

    a, b = side(40), side(50)
    schema = "gnum long, data array<double>, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double"
    meets = lambda p, q: all(p[2 * k + 2] <= q[2 * k + 3] and q[2 * k + 2] <= p[2 * k + 3] for k in range(3))
    want = sorted((p[0], q[0], p[0] * 1000.0 + q[0]) for p in a for q in b if meets(p, q) and (p[0] + q[0]) % 2)

    def odd(x, y):
        keep = np.flatnonzero((x[:, 0] + y[:, 0]) % 2)
        return keep, {"m": x[keep, 0] * 1000 + y[keep, 0]}

    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for block in (8, spatial.BLOCK):
        assert sorted(tuple(r) for r in spatial.meet_in_blocks(left, right, odd, ["m"], block=block).collect()) == want
    assert not spatial.meet_in_blocks(left, right.where("false"), odd, ["m"]).count()


def test_cut_pairs_are_not_shuffled(spark):
    """Elements meet lines and each other in blocks; what is shuffled are the elements, not the pairs."""
    for name in ("lines_volumes", "intersect_volumes"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_common_of_tetras():
    """A tetrahedron shares its whole with itself, nothing with one beyond a face, and as much with its window from either side."""
    rng = np.random.default_rng(3)
    t = rng.normal(size=(50, 4, 3))
    flip = np.linalg.det(t[:, 1:] - t[:, :1]) < 0
    t[flip] = t[flip][:, [0, 2, 1, 3]]
    size = np.linalg.det(t[:, 1:] - t[:, :1]) / 6
    assert np.allclose(intersection.common(t, t), size, atol=1e-12)
    assert np.allclose(intersection.common(t[:25], t[25:]), intersection.common(t[25:], t[:25]), atol=1e-12)
    away = t.copy()
    away[:, :, 0] += 20
    assert not intersection.common(t, away).any() and len(intersection.common(t[:0], t[:0])) == 0


def test_close_pairs_are_not_shuffled(spark):
    """Pairs near each other come from blocks alone: no join of the pairs with themselves, and both points' lengths count."""
    for name in ("epsilon_pairs", "ball_points"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[0] and "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]
    c = spark.createDataFrame([(k, k * 1.0, 0.0, 0.0, 1.0 + k % 2) for k in range(30)], "gnum long, x double, y double, z double, l double")
    got = sorted(tuple(r) for r in spatial.close_pairs(c, 1.0, "l").collect())
    assert got == sorted([(k, k + 1, 1.0) for k in range(29)] + [(k, k + 2, 4.0) for k in range(1, 28, 2)])


def test_shared_ids_read_the_graph_once(spark):
    from gridloom.operators import ids

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    kind = "rank int, part int, lnum int, o_rank int, o_part int, o_lnum int"
    graph = spark.createDataFrame([(0, 0, 1, 0, 1, 5), (0, 1, 5, 0, 0, 1)], kind).mapInPandas(counted, kind)
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 5), (0, 1, 6)], "rank int, part int, lnum int")
    assert sorted(map(tuple, ids.from_shared(df, graph, "id").collect())) == [(0, 0, 1, 2), (0, 0, 2, 1), (0, 1, 5, 2), (0, 1, 6, 3)]
    assert seen.value == 2


def test_boxes_meet_once_and_not_beyond_the_last_low(spark):
    """Two levels meet one way only in a join of boxes with themselves, each in its own order; boxes far larger than all that
    begins within them need no levels of their own."""
    rng = np.random.default_rng(5)
    low = rng.uniform(0, 10, (200, 2))
    size = 4.0 ** rng.integers(-4, 8, (200, 2)) * rng.uniform(0.3, 1, (200, 2))
    rows = [(int(g), *(float(v) for k in range(2) for v in (low[n, k], low[n, k] + size[n, k]))) for n, g in enumerate(rng.permutation(200))]
    b = spark.createDataFrame(rows, "gnum long, xmin double, xmax double, ymin double, ymax double")
    got = spatial.boxes_meet_within(b, ["x", "y"]).collect()
    meets = lambda p, q: p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]
    assert sorted(tuple(r) for r in got) == sorted((*p, *q) for p in rows for q in rows if p[0] < q[0] and meets(p, q))
    ends = {k: (f"{k}min", f"{k}max") for k in "xy"}
    a, both = (spatial.placed(b, b, ends, ends, ["x", "y"], same)[0] for same in (True, False))
    assert a.count() < 0.7 * both.count()
    wide = b.select("gnum", "xmin", F.when(F.col("gnum") % 2 == 0, 1e6 * (F.col("gnum") + 1)).otherwise(F.col("xmin") + 1).alias("xmax"), "ymin", (F.col("ymin") + 1).alias("ymax"))
    assert spatial.placed(wide, wide, ends, ends, ["x", "y"])[0].select("_pair").distinct().count() <= 16


def test_measures_round_as_in_the_sql(spark):
    import duckdb

    from gridloom.plans import queries

    values = [0.0, 0.00005, 0.00015, 1.00025, 2.5, 33.33335, 199.99995, 1234.56785]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(queries.rounded("v", 4)).collect()]
    assert got == [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 4)").fetchall()[0][0] for v in values]
    assert "round(" not in plan_of(QUERIES["intersect_boxes"](spark, SF))


def test_what_is_new_is_grouped_first(spark):
    """What is looked up among the seen is what a grouping gives, not what it gets: the join comes after it."""
    from gridloom.functions.tables import absent

    many = spark.range(3000).select((F.col("id") % 50).alias("g"), (F.col("id") % 7).alias("h"))
    seen = materialise(spark.range(40).select(F.col("id").alias("g"), (F.col("id") % 7).alias("h")))
    new = absent(many.distinct(), seen, ["g", "h"])
    plan = plan_of(new)
    assert "LeftAnti" not in plan and plan.index("Join") < plan.index("HashAggregate")
    assert sorted(map(tuple, new.collect())) == sorted((g, h) for g in range(50) for h in range(7) if g >= 40 or h != g % 7)
    assert new.columns == ["g", "h"]


def test_ghosts_of_shared_entities(spark):
    """Parts travel as arrays: an entity of many parts and cells, numbers below 0 and layers beyond the first."""
    from gridloom.operators import partition

    rng = np.random.default_rng(9)
    cells = [(int(p), g) for g, p in enumerate(rng.integers(-3, 9, 80))]
    links = [(g, 0, int(e) if k % 2 else -int(e)) for k, (g, e) in enumerate(zip(rng.integers(0, 80, 150), rng.integers(1, 90, 150), strict=True))]
    got = sorted(map(tuple, partition.ghost_layers(spark.createDataFrame(cells, "part int, gnum long"), spark.createDataFrame([(int(a), b, c) for a, b, c in links], "src long, pos int, dst long"), 3).collect()))
    of = {}
    for g, _, e in links:
        of.setdefault(abs(e), set()).add(int(g))
    want = []
    for part in {p for p, _ in cells}:
        held = {g for p, g in cells if p == part}
        want += [(part, g, 0) for g in held]
        for layer in (1, 2, 3):
            new = set().union(*[s for s in of.values() if s & held]) - held
            want += [(part, g, layer) for g in new]
            held |= new
    assert got == sorted(want)


def test_far_candidates_are_not_sorted(spark):
    """A round of the neighbour search keeps what lies within a cell's size: no more could settle a target in it."""
    rng = np.random.default_rng(6)
    c = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.normal(size=(300, 3)))], "gnum long, x double, y double, z double")
    met = c.crossJoin(c.select(F.col("gnum").alias("src"), *[F.col(a).alias(f"s{a}") for a in "xyz"]))
    whole = sorted(tuple(r) for r in spatial.first_k(met, 3, "xyz").collect())
    assert sorted(tuple(r) for r in spatial.first_k(met, 3, "xyz", 0.25).collect()) == [r for r in whole if r[2] <= 0.25]
    assert sorted(tuple(r) for r in spatial.nearest(c, c, 3).collect()) == whole
