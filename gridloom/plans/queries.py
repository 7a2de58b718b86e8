"""Queries over the driver's tables with the library's operators, and the SQL of the same results.

Arrays come out exploded and computed doubles rounded, so that rows compare by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import sfc
from gridloom.functions.tables import materialise, numbered
from gridloom.operators import connectivity, exchange, ids, partition, reduce, spatial
from gridloom.plans.registry import ORACLES, QUERIES, query, read
from gridloom.sources import generators

__all__ = ["ORACLES", "QUERIES"]

def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a partitioned frame: the line number is the part and its parity the rank, the order key the global id."""
    li = read(spark, sf_dir, "lineitem")
    return li.select((F.col("l_linenumber") % 2).cast("int").alias("rank"), F.col("l_linenumber").alias("part"), F.col("l_orderkey").cast("int").alias("lnum"), F.col("l_orderkey").alias("gnum"), "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")


LI = "(SELECT CAST(l_linenumber % 2 AS INTEGER) AS rank, l_linenumber AS part, CAST(l_orderkey AS INTEGER) AS lnum, l_orderkey AS gnum, l_quantity, l_extendedprice, l_partkey, l_suppkey FROM lineitem)"


@query(f"WITH l AS {LI} SELECT part, gnum, round(sum(l_quantity) OVER (PARTITION BY gnum), 4) AS total, round(o_totalprice, 4) AS price FROM l JOIN orders ON gnum = o_orderkey")
def ptb_reduce_lookup(spark, sf_dir):
    f = reduce.reduce_fields(frame(spark, sf_dir), ["l_quantity"], "sum")
    block = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum"), "o_totalprice")
    return exchange.to_parts(f, block).select("part", "gnum", F.round("sum_l_quantity", 4).alias("total"), F.round("o_totalprice", 4).alias("price"))


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_orderkey) AS gnum FROM lineitem")
def gnum_from_parent(spark, sf_dir):
    return ids.from_keys(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])


@query("SELECT l_partkey, l_suppkey, l_linenumber, dense_rank() OVER (ORDER BY 1 + abs(l_partkey) + abs(l_suppkey), l_partkey, l_suppkey) AS gnum FROM lineitem")
def gnum_nuplet(spark, sf_dir):
    return ids.from_tuples(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber"), ["l_partkey", "l_suppkey"])


@query(f"WITH l AS {LI} SELECT gnum, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY gnum ORDER BY rank, part, lnum, l_partkey) AS k FROM l) WHERE k = 1")
def ptb_cleanup(spark, sf_dir):
    return exchange.to_block(frame(spark, sf_dir), ["l_partkey"], "cleanup")


@query(f"WITH l AS {LI} SELECT gnum, CAST(row_number() OVER (PARTITION BY gnum ORDER BY rank, part, lnum, l_partkey) - 1 AS INTEGER) AS pos, l_partkey FROM l")
def ptb_merge(spark, sf_dir):
    return exchange.to_block(frame(spark, sf_dir), ["l_partkey"], "merge").select("gnum", F.col("pos").cast("int").alias("pos"), "l_partkey")


@query("SELECT l_orderkey AS gnum, count(*) AS n FROM lineitem GROUP BY 1")
def ptb_count(spark, sf_dir):
    return exchange.to_block(frame(spark, sf_dir), [], "count")


@query(f"WITH l AS {LI} SELECT part, gnum, count(*) OVER (PARTITION BY gnum) AS n, CAST(sum(l_partkey) OVER (PARTITION BY gnum) AS BIGINT) AS total FROM l")
def ptb_reverse_merge(spark, sf_dir):
    r = exchange.reverse(frame(spark, sf_dir), ["l_partkey"])
    return r.select("part", "gnum", F.size("l_partkey").cast("long").alias("n"), F.aggregate("l_partkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT l_linenumber AS part, -l_orderkey AS gnum, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def btp_lookup(spark, sf_dir):
    signed = frame(spark, sf_dir).withColumn("gnum", -F.col("gnum"))
    block = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum"), "o_custkey")
    return exchange.to_parts(signed, block).select("part", "gnum", "o_custkey")


@query("SELECT c_custkey AS gnum, o_orderkey, coalesce(o_orderkey, 0) AS filled FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def btp_sparse(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gnum"))
    block = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gnum"), "o_orderkey")
    return exchange.to_parts(c, block, "left").select("gnum", "o_orderkey", F.coalesce("o_orderkey", F.lit(0)).alias("filled"))


def bridge(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gnum1"), F.col("l_suppkey").alias("gnum2"))


@query("SELECT l_partkey AS gnum1, l_suppkey AS gnum2, round(p_retailprice, 4) AS price FROM lineitem JOIN part ON l_partkey = p_partkey")
def ptp_bridge(spark, sf_dir):
    v = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gnum"), F.round("p_retailprice", 4).alias("price"))
    return exchange.across(bridge(spark, sf_dir), v)


@query("SELECT p_partkey AS gnum FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def ptp_ref(spark, sf_dir):
    b = bridge(spark, sf_dir).select(F.col("gnum2").alias("gnum1"), F.col("gnum1").alias("gnum2"))
    return exchange.referenced(b, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gnum")))


@query("SELECT o_orderkey AS gnum FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def ptp_unref(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gnum1"), F.col("l_orderkey").alias("gnum2"))
    return exchange.unreferenced(b, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum")))


@query("SELECT gnum2, gnum1, CAST(row_number() OVER (PARTITION BY gnum2 ORDER BY gnum1) AS INTEGER) AS pos FROM (SELECT DISTINCT l_suppkey AS gnum2, l_partkey AS gnum1 FROM lineitem)")
def ptp_come_from(spark, sf_dir):
    return exchange.come_from(bridge(spark, sf_dir))


@query(f"WITH l AS {LI} SELECT gnum, rank, part, lnum, CAST(row_number() OVER (PARTITION BY gnum ORDER BY rank, part, lnum) AS INTEGER) AS pos FROM l")
def gnum_location(spark, sf_dir):
    return exchange.location(frame(spark, sf_dir))


def _reduce(op):
    def run(spark, sf_dir):
        return reduce.reduce_fields(frame(spark, sf_dir), ["l_extendedprice"], op).select("part", "gnum", F.round(f"{op}_l_extendedprice", 4).alias("v"))

    run.__name__ = f"reduce_{op}"
    return query(f"SELECT l_linenumber AS part, l_orderkey AS gnum, round({op}(l_extendedprice) OVER (PARTITION BY l_orderkey), 4) AS v FROM lineitem")(run)


for _op in ("min", "max", "sum"):
    _reduce(_op)


@query("SELECT l_linenumber AS part, l_orderkey AS gnum, round(sum(l_extendedprice * l_quantity) OVER (PARTITION BY l_orderkey) / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS mean FROM lineitem")
def global_mean(spark, sf_dir):
    return reduce.mean_fields(frame(spark, sf_dir), ["l_extendedprice"], "l_quantity").select("part", "gnum", F.round("mean_l_extendedprice", 6).alias("mean"))


@query("SELECT l_linenumber AS part, l_orderkey AS gnum, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS w FROM lineitem")
def global_weight(spark, sf_dir):
    return reduce.global_weights(frame(spark, sf_dir), "l_quantity").select("part", "gnum", F.round("global_weight", 4).alias("w"))


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT CAST(r AS INTEGER) AS rank, r * (n // 7) + least(r, n % 7) AS lo, (r + 1) * (n // 7) + least(r + 1, n % 7) AS hi FROM n, range(7) t(r)")
def distrib_uniform(spark, sf_dir):
    return ids.uniform_distribution(spark, read(spark, sf_dir, "orders").count(), 7)


@query("SELECT o_orderkey AS gnum, CAST(least(floor((2 * sum(w) OVER (ORDER BY o_orderkey) - w) * 8 / (2 * sum(w) OVER ())), 7) AS INTEGER) AS rank FROM (SELECT o_orderkey, 1 + o_custkey % 5 AS w FROM orders)")
def distrib_weighted(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum"), (1 + F.col("o_custkey") % 5).alias("w"))
    return ids.weighted_split(o, "w", 8, ["gnum"]).select("gnum", "rank")


@query("SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem")
def unique_pairs(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()


@query("SELECT l_orderkey AS gnum, l_linenumber AS part, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def unique_order(spark, sf_dir):
    return ids.unique_in_order(frame(spark, sf_dir).select("part", "l_partkey", "gnum"), "gnum", ["part", "l_partkey"])


def order_part(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_quantity") > 25, F.col("l_partkey")).otherwise(-F.col("l_partkey")).alias("dst"))


OP = "(SELECT l_orderkey AS src, l_linenumber AS pos, CASE WHEN l_quantity > 25 THEN l_partkey ELSE -l_partkey END AS dst FROM lineitem)"


@query(f"SELECT abs(dst) AS src, CASE WHEN dst < 0 THEN -src ELSE src END AS dst FROM {OP}")
def conn_transpose(spark, sf_dir):
    return connectivity.transpose(order_part(spark, sf_dir)).select("src", "dst")


@query(f"SELECT DISTINCT a.src, l_suppkey AS dst FROM {OP} a JOIN lineitem ON abs(a.dst) = l_partkey")
def conn_combine(spark, sf_dir):
    ps = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("dst"))
    return connectivity.combine(order_part(spark, sf_dir), ps).select("src", "dst")


@query(f"SELECT DISTINCT a.src, b.src AS dst FROM {OP} a JOIN {OP} b ON abs(a.dst) = abs(b.dst)")
def conn_dual_self(spark, sf_dir):
    return connectivity.dual(order_part(spark, sf_dir), keep_self=True)


@query(f"SELECT DISTINCT a.src, b.src AS dst FROM {OP} a JOIN {OP} b ON abs(a.dst) = abs(b.dst) WHERE a.src <> b.src")
def conn_dual_noself(spark, sf_dir):
    return connectivity.dual(order_part(spark, sf_dir))


@query(f"SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY p, dst) AS INTEGER) AS pos FROM (SELECT src, dst, min(pos) AS p FROM {OP} GROUP BY 1, 2)")
def conn_compress(spark, sf_dir):
    return connectivity.compress(order_part(spark, sf_dir))


def groups(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select(F.lit("segment").alias("kind"), (F.ascii("c_mktsegment")).alias("group"), F.col("c_nationkey").cast("long").alias("gnum"))


GR = "(SELECT DISTINCT 'segment' AS kind, ascii(c_mktsegment) AS g, CAST(c_nationkey AS BIGINT) AS gnum FROM customer)"


@query(f"SELECT gnum, kind, g AS \"group\", CAST(row_number() OVER (PARTITION BY gnum ORDER BY kind, g) AS INTEGER) AS pos FROM {GR}")
def group_transpose(spark, sf_dir):
    return connectivity.group_transpose(groups(spark, sf_dir))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS edge, l_suppkey AS face FROM lineitem),
g AS (SELECT edge, count(*) AS n, list_sort(list(DISTINCT s_nationkey % 4)) AS gs FROM e JOIN supplier ON face = s_suppkey GROUP BY 1)
SELECT edge, CAST(len(gs) AS INTEGER) AS n, dense_rank() OVER (ORDER BY gs) AS ridge FROM g WHERE n = 1 OR len(gs) > 1""")
def ridge_edges(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    g = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gnum"), (F.col("s_nationkey") % 4).alias("group"))
    return connectivity.ridges(e, g).select("edge", F.size("groups").alias("n"), "ridge")


@query(f"WITH c AS (SELECT * FROM {OP} WHERE src % 3 = 0) SELECT dense_rank() OVER (ORDER BY src) AS src, pos, dense_rank() OVER (ORDER BY abs(dst)) * CASE WHEN dst < 0 THEN -1 ELSE 1 END AS dst FROM c")
def extract_reid(spark, sf_dir):
    c = order_part(spark, sf_dir)
    return connectivity.extract(c, c.where("src % 3 = 0").select(F.col("src").alias("gnum")))[0]


@query("SELECT o_orderkey AS gnum FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unconnected_anti(spark, sf_dir):
    v = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum"))
    return connectivity.unconnected(v, read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_orderkey")).alias("dst")))


@query("SELECT o_orderkey AS gnum, CAST(ntile(6) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS part FROM orders")
def split_implicit(spark, sf_dir):
    return partition.implicit_split(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum")), 6)


@query("SELECT CAST(l_linenumber AS INTEGER) AS part, l_orderkey AS face, CAST(row_number() OVER (PARTITION BY l_linenumber ORDER BY greatest(l_partkey, l_suppkey), least(l_partkey, l_suppkey), l_orderkey) AS INTEGER) AS lnum FROM lineitem")
def renum_lexicographic(spark, sf_dir):
    f = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("part"), F.col("l_orderkey").alias("face"), F.col("l_partkey").alias("c1"), F.col("l_suppkey").alias("c2"))
    return partition.renumber_faces(f).select("part", "face", "lnum")


@query(f"WITH l AS {LI} SELECT part, gnum, min(rank) OVER (PARTITION BY gnum) AS own_rank, CAST(min(rank * 1000 + part) OVER (PARTITION BY gnum) % 1000 AS INTEGER) AS own_part, count(*) OVER (PARTITION BY gnum) AS copies FROM l")
def halo_owner(spark, sf_dir):
    return exchange.owners(frame(spark, sf_dir)).select("part", "gnum", "own_rank", "own_part", "copies")


@query(f"WITH l AS {LI} SELECT a.gnum, a.rank, a.part, b.rank AS o_rank, b.part AS o_part FROM l a JOIN l b USING (gnum) WHERE a.part <> b.part")
def comm_graph(spark, sf_dir):
    return exchange.shared_graph(frame(spark, sf_dir)).select("gnum", "rank", "part", "o_rank", "o_part")


@query(f"""WITH c AS (SELECT DISTINCT CAST(src % 4 AS INTEGER) AS part, src AS gnum FROM {OP}), d AS (SELECT DISTINCT a.src, b.src AS dst FROM {OP} a JOIN {OP} b ON abs(a.dst) = abs(b.dst) WHERE a.src <> b.src)
SELECT part, gnum, 0 AS layer FROM c UNION ALL SELECT part, dst, 1 FROM (SELECT DISTINCT part, dst FROM c JOIN d ON gnum = src EXCEPT SELECT part, gnum FROM c)""")
def ghost_layer(spark, sf_dir):
    c = order_part(spark, sf_dir)
    cells = c.select((F.col("src") % 4).cast("int").alias("part"), F.col("src").alias("gnum")).distinct()
    return partition.ghost_layers(cells, c, 1)


_BITS = " + ".join(f"((x >> {i}) & 1) * {1 << (2 * i + 1)} + ((y >> {i}) & 1) * {1 << (2 * i)}" for i in range(16))


@query(f"SELECT o_orderkey, CAST({_BITS} AS BIGINT) AS key FROM (SELECT o_orderkey, CAST(o_orderkey % 65536 AS BIGINT) AS x, CAST(o_custkey % 65536 AS BIGINT) AS y FROM orders)")
def morton_key(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", sfc.morton([F.col("o_orderkey") % 65536, F.col("o_custkey") % 65536], 16).alias("key"))


def cloud(spark, sf_dir):
    """The first three components of the vectors as points."""
    e = read(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("gnum"), *[F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")])


CL = "(SELECT vec_id + 1 AS gnum, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
D2 = "((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


@query(f"WITH c AS {CL} SELECT gnum, src, round(d, 9) AS dist2, CAST(k AS INTEGER) AS pos FROM (SELECT a.gnum, b.gnum AS src, {D2} AS d, row_number() OVER (PARTITION BY a.gnum ORDER BY {D2}, b.gnum) AS k FROM c a, c b) WHERE k <= 3")
def knn(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return spatial.nearest(c, c, 3).select("gnum", "src", F.round("dist2", 9).alias("dist2"), "pos")


@query(f"WITH c AS {CL} SELECT src, count(*) AS n FROM (SELECT b.gnum AS src, row_number() OVER (PARTITION BY a.gnum ORDER BY {D2}, b.gnum) AS k FROM c a, c b) WHERE k <= 3 GROUP BY 1")
def reverse_knn(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return spatial.reverse_nearest(spatial.nearest(c, c, 3)).groupBy("src").agg(F.count("*").alias("n"))


def rounded(name: str, digits: int):
    """A double of at least 0, rounded half up in doubles as the SQL's engine does: F.round goes through decimals, which
    takes longer than a join takes to find the pair."""
    return F.floor(F.col(name) * 10.0**digits + 0.5) / 10.0**digits


def price_boxes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gnum"), F.col("p_retailprice").alias("xmin"), (F.col("p_retailprice") + F.col("p_size") * F.when(F.col("p_partkey") % 50 == 0, 40.0).otherwise(0.1)).alias("xmax"), F.col("p_size").cast("double").alias("ymin"), (F.col("p_size") + F.col("p_partkey") % 3).cast("double").alias("ymax"))
    return p


PB = "(SELECT p_partkey AS gnum, p_retailprice AS xmin, p_retailprice + p_size * CASE WHEN p_partkey % 50 = 0 THEN 40.0::DOUBLE ELSE 0.1::DOUBLE END AS xmax, CAST(p_size AS DOUBLE) AS ymin, CAST(p_size + p_partkey % 3 AS DOUBLE) AS ymax FROM part)"


@query(f"WITH b AS {PB} SELECT b.gnum AS b_gnum, p.p_partkey AS gnum FROM part p JOIN b ON p.p_retailprice BETWEEN xmin AND xmax AND p.p_size BETWEEN ymin AND ymax")
def box_points(spark, sf_dir):
    pts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gnum"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return spatial.points_in_boxes(pts, price_boxes(spark, sf_dir), ["x", "y"]).select("b_gnum", "gnum")


@query(f"WITH b AS {PB} SELECT a.gnum AS a_gnum, b.gnum AS b_gnum FROM b a JOIN b ON a.gnum < b.gnum AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax")
def box_box(spark, sf_dir):
    return spatial.boxes_meet_within(price_boxes(spark, sf_dir), ["x", "y"]).select("a_gnum", "b_gnum")


@query(f"WITH b AS {PB}, m AS (SELECT a.gnum AS a_gnum, b.gnum AS b_gnum, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS v FROM b a JOIN b ON a.gnum < b.gnum AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax) SELECT a_gnum, b_gnum, round(v, 4) AS measure FROM m WHERE v > 1e-9")
def intersect_boxes(spark, sf_dir):
    return spatial.box_overlap(spatial.boxes_meet_within(price_boxes(spark, sf_dir), ["x", "y"]), ["x", "y"]).where("measure > 1e-9").select("a_gnum", "b_gnum", rounded("measure", 4).alias("measure"))


@query(f"WITH c AS {CL} SELECT b.gnum AS b_gnum, a.gnum, round({D2}, 9) AS dist2 FROM c a, c b WHERE {D2} <= 0.01")
def ball_points(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return spatial.points_in_balls(c, c.withColumn("radius", F.lit(0.1))).select("b_gnum", "gnum", F.round("dist2", 9).alias("dist2"))


@query(f"WITH c AS {CL} SELECT a.gnum AS gnum1, b.gnum AS gnum2, round({D2}, 9) AS dist2 FROM c a, c b WHERE a.gnum < b.gnum AND {D2} <= 0.0064")
def epsilon_pairs(spark, sf_dir):
    return spatial.close_pairs(cloud(spark, sf_dir), 0.08).select("gnum1", "gnum2", F.round("dist2", 9).alias("dist2"))


def with_corners(cells, vertices):
    """(gnum, a, b, c, d): the corner points of tetrahedra."""
    at = cells.select("gnum", F.posexplode("vtx").alias("pos", "v")).join(vertices.withColumnRenamed("gnum", "v"), "v")
    return at.groupBy("gnum").agg(*[F.first(F.when(F.col("pos") == k, F.struct("x", "y", "z")), ignorenulls=True).alias(n) for k, n in enumerate("abcd")])


@query(f"WITH c AS {CL} SELECT gnum, CAST(least(floor((x + 1) / 2 * 9), 8) + least(floor((y + 1) / 2 * 9), 8) * 9 + least(floor((z + 1) / 2 * 9), 8) * 81 + 1 AS BIGINT) AS cell FROM c WHERE abs(x) < 1 AND abs(y) < 1 AND abs(z) < 1")
def locate_cube(spark, sf_dir):
    """Containing hexahedron of each point, by its six tetrahedra."""
    v = generators.cube_vertices(spark, 10, 2.0, (-1.0, -1.0, -1.0))
    return spatial.locate_in_tetras(cloud(spark, sf_dir), with_corners(generators.cube_tetras(spark, 10), v)).select("gnum", F.expr("(elt - 1) div 6 + 1").alias("cell"))


@query(f"WITH c AS {CL} SELECT gnum, round(z * z + greatest(abs(x) - 1, 0) ** 2 + greatest(abs(y) - 1, 0) ** 2, 6) AS dist2 FROM c")
def distance_to_plane(spark, sf_dir):
    """Squared distance of all points to a square of triangles."""
    v, q = generators.rectangle(spark, 12, 12, 2.0, 2.0)
    v = v.select("gnum", F.struct((F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), "z").alias("p"))
    tri = q.select("gnum", F.posexplode(F.array(*[F.array(*[F.get("vtx", F.lit(i)) for i in t]) for t in ((0, 1, 2), (0, 2, 3))])).alias("k", "vtx"))
    at = tri.select((F.col("gnum") * 2 + F.col("k")).alias("gnum"), F.posexplode("vtx").alias("pos", "v")).join(v.withColumnRenamed("gnum", "v"), "v")
    t = at.groupBy("gnum").agg(*[F.max(F.when(F.col("pos") == k, F.col("p"))).alias(n) for k, n in enumerate("abc")])
    return spatial.distance_to_triangles(cloud(spark, sf_dir), t).select("gnum", F.round("dist2", 6).alias("dist2"))


def _hilbert_sql(level: int) -> str:
    """The fold of the curve's levels as nested selects."""
    out = "SELECT o_orderkey, CAST(o_orderkey % 1024 AS BIGINT) AS x, CAST(o_custkey % 1024 AS BIGINT) AS y, CAST(0 AS BIGINT) AS d FROM orders"
    for i in range(level - 1, -1, -1):
        n = 1 << i
        out = f"SELECT o_orderkey, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {n} - 1 - fy ELSE fy END ELSE fx END AS x, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {n} - 1 - fx ELSE fx END ELSE fy END AS y, d + xor(3 * rx, ry) * {n * n} AS d FROM (SELECT *, x - rx * {n} AS fx, y - ry * {n} AS fy FROM (SELECT *, CAST(x >= {n} AS BIGINT) AS rx, CAST(y >= {n} AS BIGINT) AS ry FROM ({out})))"
    return f"SELECT o_orderkey, CAST(d AS BIGINT) AS key FROM ({out})"


@query(_hilbert_sql(10))
def hilbert_order(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", sfc.hilbert2(F.col("o_orderkey") % 1024, F.col("o_custkey") % 1024, 10).alias("key"))


def entities(spark, sf_dir):
    """The distinct places of lineitem's frame."""
    return frame(spark, sf_dir).select("rank", "part", "lnum", "gnum").distinct()


EN = f"(SELECT DISTINCT rank, part, lnum, gnum FROM {LI})"


@query(f"""WITH e AS {EN}, o AS (SELECT *, min(rank * 1000 + part) OVER (PARTITION BY gnum) AS own, CAST(count(*) OVER (PARTITION BY gnum) > 1 AS INTEGER) AS shared FROM e)
SELECT rank, part, lnum, dense_rank() OVER (ORDER BY own, shared, lnum) AS id FROM o""")
def gnum_shared(spark, sf_dir):
    """Dense ids of entities whose copies only the communication graph tells."""
    e = materialise(entities(spark, sf_dir))
    return ids.from_shared(e.drop("gnum"), exchange.shared_graph(e).drop("gnum"), "id")


RANKED = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS gnum, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS image FROM orders)"


def price_order(spark, sf_dir):
    """The permutation from the order of keys to the order of prices."""
    o = numbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "gnum")
    return numbered(o, ["o_totalprice", "o_orderkey"], "image")


@query(f"SELECT image AS gnum, gnum AS image FROM {RANKED}")
def perm_inverse(spark, sf_dir):
    return ids.invert(price_order(spark, sf_dir).select("gnum", "image"))


@query(f"SELECT image AS gnum, o_orderkey FROM {RANKED}")
def perm_apply(spark, sf_dir):
    p = price_order(spark, sf_dir)
    return ids.permute(p.select("gnum", "o_orderkey"), p.select("gnum", "image"))


@query("SELECT CAST(CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice = 400000 THEN 14 WHEN o_totalprice > 400000 THEN 15 ELSE floor((o_totalprice - 50000) / 25000) + 1 END AS INTEGER) AS bin, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, sf_dir):
    return ids.histogram(read(spark, sf_dir, "orders"), "o_totalprice", 50_000, 400_000, 14)


@query("SELECT l_partkey AS a, l_suppkey AS b, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1, 2")
def unique_sum(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.round(F.sum("l_quantity"), 4).alias("total"))


@query("SELECT o_orderkey AS gnum, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def extract_semi(spark, sf_dir):
    chosen = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum"), "o_custkey").join(chosen, "o_custkey", "left_semi")


@query(f"WITH e AS {EN} SELECT a.rank, a.part, a.gnum, b.part AS o_part, round(o_totalprice * b.part, 4) AS v FROM e a JOIN e b ON a.gnum = b.gnum AND a.part <> b.part JOIN orders ON o_orderkey = b.gnum")
def neighbour_exchange(spark, sf_dir):
    """Each copy gets the values of its neighbours along the communication graph."""
    e = entities(spark, sf_dir)
    price = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gnum"), "o_totalprice")
    values = e.join(price, "gnum").select("rank", "part", "lnum", F.round(F.col("o_totalprice") * F.col("part"), 4).alias("v"))
    return exchange.neighbours(values, exchange.shared_graph(e)).select("rank", "part", "gnum", "o_part", "v")


@query("""WITH c AS (SELECT max(c_custkey) AS n FROM customer), u AS (SELECT c_custkey AS gnum, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey + n, s_acctbal FROM supplier, c)
SELECT gnum, round(bal, 4) AS bal FROM u""")
def multi_block(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    size = c.agg(F.max("c_custkey")).first()[0] or 0
    both = exchange.multi_block([c.select(F.col("c_custkey").alias("gnum"), F.col("c_acctbal").alias("bal")), s.select(F.col("s_suppkey").alias("gnum"), F.col("s_acctbal").alias("bal"))], [size, 0])
    return both.withColumn("bal", F.round("bal", 4))


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS gnum, o_custkey FROM orders), n AS (SELECT count(*) AS n FROM o),
d AS (SELECT CAST(r AS INTEGER) AS rank, r * (n // 5) + least(r, n % 5) AS lo, (r + 1) * (n // 5) + least(r + 1, n % 5) AS hi FROM n, range(5) t(r))
SELECT gnum, o_custkey, rank, gnum - 1 - lo AS pos FROM o JOIN d ON gnum - 1 >= lo AND gnum - 1 < hi""")
def block_relayout(spark, sf_dir):
    o = numbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "gnum").select("gnum", "o_custkey")
    return exchange.to_other_block(o, ids.uniform_distribution(spark, o.count(), 5))


@query("SELECT DISTINCT l_partkey AS gnum1, CAST(l_suppkey % 3 AS INTEGER) AS rank, CAST(l_suppkey % 7 AS INTEGER) AS part, CAST(l_suppkey AS INTEGER) AS lnum, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS pos, round(p_retailprice, 4) AS price FROM lineitem JOIN part ON l_partkey = p_partkey")
def ptp_triplet(spark, sf_dir):
    """A bridge whose second side is named by place."""
    b = bridge(spark, sf_dir).distinct()
    at = [(F.col("gnum2") % 3).cast("int").alias("o_rank"), (F.col("gnum2") % 7).cast("int").alias("o_part"), F.col("gnum2").cast("int").alias("o_lnum")]
    v = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gnum"), F.round("p_retailprice", 4).alias("price"))
    return exchange.across_triplets(b.select("gnum1", *at), v)


@query("SELECT l_partkey AS gnum1, l_suppkey AS gnum2, round(s_acctbal, 4) AS bal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def ptp_back(spark, sf_dir):
    v = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gnum"), F.round("s_acctbal", 4).alias("bal"))
    return exchange.back(bridge(spark, sf_dir), v).select("gnum1", "gnum2", "bal")


def cube_parts(spark):
    """The cube of 7 vertices an axis in five parts: split, signed cell faces (positive outwards on the cell that the normal
    leaves) and the vertices of the faces."""
    f = generators.cube_faces(spark, 7)
    axis, at = F.col("axis"), F.col("group")
    low = F.when(at % 2 == 1, F.lit(0)).otherwise(F.col("c1"))  # a face of group 1, 3 or 5 has its cell above it alone
    high = F.when(at % 2 == 1, F.col("c1")).otherwise(F.col("c2"))
    both = f.select("gnum", axis, low.alias("low"), high.alias("high"))
    cell_face = both.where("low > 0").select(F.col("low").alias("src"), (2 * axis + 1).alias("pos"), F.col("gnum").alias("dst"))
    cell_face = cell_face.unionByName(both.where("high > 0").select(F.col("high").alias("src"), (2 * axis).alias("pos"), (-F.col("gnum")).alias("dst")))
    # the ring turns around the axis on axes 0 and 2 and against it on axis 1
    ring = F.when(axis == 1, F.reverse("vtx")).otherwise(F.col("vtx"))
    face_vtx = f.select(F.col("gnum").alias("src"), F.posexplode(ring).alias("pos", "dst"))
    groups = f.where("group > 0").select(F.lit("side").alias("kind"), "group", "gnum")
    return partition.implicit_split(spark.range(1, 217).select(F.col("id").alias("gnum")), 5), cell_face, face_vtx, groups


@query(f"""WITH c AS {CL} SELECT gnum, abs(x) <= 1 AND abs(y) <= 1 AND abs(z) <= 1 AS located,
round(greatest(abs(x) - 1, 0) ** 2 + greatest(abs(y) - 1, 0) ** 2 + greatest(abs(z) - 1, 0) ** 2, 6) AS dist2 FROM c""")
def locate_mixed(spark, sf_dir):
    """All points in a mesh of hexahedra, prisms, pyramids and tetrahedra, or their distance to it."""
    v = generators.cube_vertices(spark, 10, 2.0, (-1.0, -1.0, -1.0))
    return spatial.locate(cloud(spark, sf_dir), generators.cube_mixed(spark, 10), v).select("gnum", "located", F.round("dist2", 6).alias("dist2"))
