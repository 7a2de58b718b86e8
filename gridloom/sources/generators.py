"""Structured meshes, clouds and boxes from spark.range and arithmetic: no driver loops, any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import HEXA_TETRAS
from gridloom.functions.tables import materialise, numbered, shuffled
from gridloom.operators.ids import from_keys


def _ijk(df: DataFrame, n: tuple[int, int, int]) -> DataFrame:
    i, j, k = F.col("id") % n[0], F.expr(f"(id div {n[0]}) % {n[1]}"), F.expr(f"id div {n[0] * n[1]}")
    return shuffled(df).select((F.col("id") + 1).alias("gnum"), i.alias("i"), j.alias("j"), k.alias("k"))


def cube_vertices(spark: SparkSession, n: int, length: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """n ** 3 vertices (gnum, x, y, z), x first."""
    h = length / (n - 1)
    v = _ijk(spark.range(n**3), (n, n, n))
    return v.select("gnum", *[(F.col(c) * h + o).alias(a) for c, a, o in zip("ijk", "xyz", origin, strict=True)])


def _vertex(n: int, di: int, dj: int, dk: int):
    return (F.col("i") + di) + (F.col("j") + dj) * n + (F.col("k") + dk) * n * n + 1


CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))


def cube_cells(spark: SparkSession, n: int) -> DataFrame:
    """(n - 1) ** 3 hexahedra (gnum, elt_type, vtx)."""
    m = n - 1
    c = _ijk(spark.range(m**3), (m, m, m))
    return c.select("gnum", F.lit("hexa").alias("elt_type"), F.array(*[_vertex(n, *d) for d in CORNERS]).alias("vtx"))


def cube_tetras(spark: SparkSession, n: int) -> DataFrame:
    """Six tetrahedra a cell, numbered cell by cell."""
    parts = F.array(*[F.array(*[F.get("vtx", F.lit(i)) for i in t]) for t in HEXA_TETRAS])
    t = cube_cells(spark, n).select("gnum", F.posexplode(parts).alias("pos", "v"))
    return t.select(((F.col("gnum") - 1) * 6 + F.col("pos") + 1).alias("gnum"), F.lit("tetra").alias("elt_type"), F.col("v").alias("vtx"))


#: How a hexahedron is cut into the elements of each type, all around the diagonal 0-6.
CUTS = {
    "hexa": ((0, 1, 2, 3, 4, 5, 6, 7),), "prism": ((0, 1, 2, 4, 5, 6), (0, 2, 3, 4, 6, 7)),
    "pyramid": ((0, 1, 2, 3, 6), (0, 4, 5, 1, 6), (0, 3, 7, 4, 6)), "tetra": HEXA_TETRAS,
}


def cube_mixed(spark: SparkSession, n: int) -> DataFrame:
    """Elements (gnum, elt_type, vtx) of all volume types over the vertices of the cube: cells 1, 2, 3, 4, .. stay
    hexahedra or become prisms, pyramids and tetrahedra in turn; the elements of cell c are 6 (c - 1) + 1 and on."""
    parts = None
    for k, (kind, cut) in enumerate(CUTS.items()):
        one = F.array(*[F.struct(F.lit(kind).alias("elt_type"), F.array(*[F.get("vtx", F.lit(i)) for i in e]).alias("vtx")) for e in cut])
        parts = F.when(F.col("gnum") % 4 == k, one) if parts is None else parts.when(F.col("gnum") % 4 == k, one)
    e = cube_cells(spark, n).select("gnum", F.posexplode(parts).alias("pos", "e"))
    return e.select(((F.col("gnum") - 1) * 6 + F.col("pos") + 1).alias("gnum"), "e.elt_type", "e.vtx")


def cube_faces(spark: SparkSession, n: int) -> DataFrame:
    """(axis, i, j, k, c1, c2, vtx, group): 3 n (n-1)**2 faces; c2 = 0 and a group 1 .. 6 on the boundary."""
    m, out = n - 1, None
    for axis in range(3):
        dims = tuple(n if a == axis else m for a in range(3))
        f = _ijk(spark.range(n * m * m), dims)
        at = F.col("ijk"[axis])
        cell = lambda d, axis=axis: (F.col("i") + (d if axis == 0 else 0)) + (F.col("j") + (d if axis == 1 else 0)) * m + (F.col("k") + (d if axis == 2 else 0)) * m * m + 1
        c1, c2 = F.when(at == 0, cell(0)).otherwise(cell(-1)), F.when((at == 0) | (at == m), F.lit(0)).otherwise(cell(0))
        ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
        corner = [tuple((0 if a == axis else r[[x for x in range(3) if x != axis].index(a)]) for a in range(3)) for r in ring]
        group = F.when(at == 0, 2 * axis + 1).when(at == m, 2 * axis + 2).otherwise(0)
        f = f.select((F.col("gnum") + axis * n * m * m).alias("gnum"), F.lit(axis).alias("axis"), c1.cast("long").alias("c1"), c2.cast("long").alias("c2"), F.array(*[_vertex(n, *c) for c in corner]).alias("vtx"), group.alias("group"))
        out = f if out is None else out.unionByName(f)
    return shuffled(out)


def rectangle(spark: SparkSession, nx: int, ny: int, lx: float = 1.0, ly: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and quads."""
    v = _ijk(spark.range(nx * ny), (nx, ny, 1)).select("gnum", (F.col("i") * (lx / (nx - 1))).alias("x"), (F.col("j") * (ly / (ny - 1))).alias("y"), F.lit(0.0).alias("z"))
    q = _ijk(spark.range((nx - 1) * (ny - 1)), (nx - 1, ny - 1, 1))
    at = lambda di, dj: (F.col("i") + di) + (F.col("j") + dj) * nx + 1
    return v, q.select("gnum", F.lit("quad").alias("elt_type"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("vtx"))


def sphere(spark: SparkSession, nu: int, nv: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """UV sphere: nu meridians, nv rings and two poles; triangles."""
    u, v = F.col("id") % nu, F.expr(f"id div {nu}")
    th, ph = u * (2 * 3.141592653589793 / nu), (v + 1) * (3.141592653589793 / (nv + 1))
    ring = spark.range(nu * nv).select((F.col("id") + 1).alias("gnum"), (F.sin(ph) * F.cos(th) * radius).alias("x"), (F.sin(ph) * F.sin(th) * radius).alias("y"), (F.cos(ph) * radius).alias("z"))
    north, south = nu * nv + 1, nu * nv + 2
    poles = spark.range(2).select((F.col("id") + north).alias("gnum"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.lit(radius) - F.col("id") * 2 * radius).alias("z"))
    at = lambda dv, du: (v + dv) * nu + (u + du) % nu + 1
    band = spark.range(nu * (nv - 1)).select(F.explode(F.array(F.array(at(0, 0), at(1, 0), at(1, 1)), F.array(at(0, 0), at(1, 1), at(0, 1)))).alias("vtx"))
    i = F.col("id")
    caps = spark.range(nu).select(F.explode(F.array(F.array(F.lit(north).cast("long"), i + 1, (i + 1) % nu + 1), F.array(F.lit(south).cast("long"), (i + 1) % nu + 1 + nu * (nv - 1), i + 1 + nu * (nv - 1)))).alias("vtx"))
    return ring.unionByName(poles), band.unionByName(caps).withColumn("elt_type", F.lit("triangle"))


def random_cloud(spark: SparkSession, n: int, seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Uniform points that depend on seed and id alone."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 53)) / float(1 << 53)
    return spark.range(n).select((F.col("id") + 1).alias("gnum"), *[(u(k) * (high - low) + low).alias(a) for k, a in enumerate("xyz")])


def random_boxes(spark: SparkSession, n: int, size: float, seed: int = 0) -> DataFrame:
    c = random_cloud(spark, n, seed)
    return c.select("gnum", *[F.col(a).alias(f"{a}min") for a in "xyz"], *[(F.col(a) + size).alias(f"{a}max") for a in "xyz"])


def icosphere(spark: SparkSession, n: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of an icosahedron whose faces are cut into n * n triangles, on the sphere. A vertex is known
    by the corners it lies between and its weights there, so faces share their edges' vertices exactly."""
    g = (1 + 5**0.5) / 2
    corners = [(s * a, t * b, 0.0) for a, b in ((1.0, g),) for s in (1, -1) for t in (1, -1)]
    corners = corners + [(0.0, x, y) for x, y, _ in corners] + [(y, 0.0, x) for x, y, _ in corners]
    near = lambda p, q: abs(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) - 4) < 1e-9
    faces = [(i, j, k) for i in range(12) for j in range(i) for k in range(j) if near(corners[i], corners[j]) and near(corners[j], corners[k]) and near(corners[i], corners[k])]

    def outward(f):
        a, b, c = (corners[i] for i in f)
        u, v = [[q - p for p, q in zip(a, x, strict=True)] for x in (b, c)]
        normal = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        return f if sum(x * y for x, y in zip(normal, a, strict=True)) > 0 else (f[0], f[2], f[1])

    table = spark.createDataFrame([(k, *outward(f)) for k, f in enumerate(faces)], "f int, p int, q int, r int")  # 20 rows
    i, j = F.expr(f"id div {n + 1}"), F.col("id") % (n + 1)
    grid = spark.range((n + 1) ** 2).select(i.cast("int").alias("i"), j.cast("int").alias("j")).where(F.col("i") + F.col("j") <= n)
    parts = F.array(*[F.struct(F.col(c).alias("c"), w.alias("w")) for c, w in (("p", F.lit(n) - F.col("i") - F.col("j")), ("q", F.col("i")), ("r", F.col("j")))])
    held = F.array_sort(F.filter(parts, lambda x: x["w"] > 0))
    key = F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["c"].cast("string"), x["w"].cast("string"))), ",")
    at = materialise(from_keys(grid.join(F.broadcast(table)).select("f", "i", "j", held.alias("held"), key.alias("key")), ["key"]).drop("key"))
    axis = [F.array(*[F.lit(c[a]) for c in corners]) for a in range(3)]
    along = lambda a: F.aggregate("held", F.lit(0.0), lambda t, x: t + F.get(axis[a], x["c"]) * x["w"])
    place = [along(a) for a in range(3)]
    v = at.groupBy("gnum").agg(F.first("held").alias("held")).select("gnum", *[c.alias(a) for c, a in zip(place, "xyz", strict=True)])
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) / radius
    own = lambda di, dj: F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"))
    up = F.when(F.col("i") + F.col("j") < n, F.array(own(0, 0), own(1, 0), own(0, 1)))
    down = F.when(F.col("i") + F.col("j") < n - 1, F.array(own(1, 0), own(1, 1), own(0, 1)))
    tri = at.select("f", "i", "j", F.explode(F.filter(F.array(up, down), lambda t: t.isNotNull())).alias("t"))
    tri = tri.select("f", "i", "j", F.xxhash64("f", "t").alias("tri"), F.posexplode("t").alias("pos", "at")).select("tri", "pos", "f", "at.i", "at.j")
    tri = tri.join(at.select("f", "i", "j", "gnum"), ["f", "i", "j"]).groupBy("tri").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gnum"))), lambda x: x["gnum"]).alias("vtx"))
    return v.select("gnum", *[(F.col(a) / size).alias(a) for a in "xyz"]), tri.select(F.lit("triangle").alias("elt_type"), "vtx")


def ball(spark: SparkSession, n: int, layers: int, radius: float = 1.0, inner: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and elements (gnum, elt_type, vtx) of a ball of icosphere shells: prisms between the shells and, unless the
    ball is hollow from `inner` outwards, tetrahedra around the center."""
    shell, tri = icosphere(spark, n)
    shell, tri = materialise(shell), materialise(numbered(tri, ["vtx"], "t"))
    size, faces = shell.count(), tri.count()
    hollow = inner > 0
    at = F.explode(F.sequence(F.lit(0 if hollow else 1), F.lit(layers))).alias("k")
    r = F.lit(inner) + F.col("k") * ((radius - inner) / layers)
    first = 0 if hollow else 1
    v = shell.select("gnum", "x", "y", "z", at).select((F.col("gnum") + (F.col("k") - first) * size).alias("gnum"), *[(F.col(a) * r).alias(a) for a in "xyz"])
    between = F.explode(F.sequence(F.lit(0), F.lit(layers - 1 - first))).alias("k")
    up = lambda d: F.transform("vtx", lambda x: x + (F.col("k") + d) * size)
    e = tri.select("t", "vtx", between) if layers > first else None
    out = None
    if e is not None:
        out = e.select((F.col("t") + F.col("k") * faces).alias("gnum"), F.lit("prism").alias("elt_type"), F.concat(up(0), up(1)).alias("vtx"))
    if not hollow:
        center = v.agg(F.max("gnum")).first()[0] + 1
        v = v.unionByName(spark.createDataFrame([(center, 0.0, 0.0, 0.0)], "gnum long, x double, y double, z double"))
        core = tri.select((F.col("t") + (layers - 1) * faces).alias("gnum"), F.lit("tetra").alias("elt_type"), F.concat(F.reverse("vtx"), F.array(F.lit(center))).alias("vtx"))
        out = core if out is None else out.unionByName(core)
    return v, out
