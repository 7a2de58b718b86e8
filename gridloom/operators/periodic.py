"""Ghost layers over several domains and periodic interfaces.

An interface pairs entities of two domains, or of one with itself, and has a transform: a 3 x 4 matrix [R | t] that takes
the place of the first entity of a pair to that of the second. A ghost is a cell together with the transform that moves
it next to the part that wants it, so one cell can be a ghost of a part several times, and of its own part too. Each layer
goes from the frontier's cells to their shared entities, across interfaces as often as that finds something new (a corner
has images over several interfaces, and over their compositions), and to the cells around all those images. Instances
are told apart by entity and transform; transforms are equal if their numbers are, to `DIGITS` places, so paths that
commute and turns that close give one ghost.

Defined results: pairs that name unknown entities reach nothing; repeated pairs count once; null ids never meet; an
interface without a transform raises; parts without cells have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tables import absent, materialise

DIGITS = 7
IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def translation(x: float, y: float = 0.0, z: float = 0.0) -> tuple[float, ...]:
    return (1.0, 0.0, 0.0, float(x), 0.0, 1.0, 0.0, float(y), 0.0, 0.0, 1.0, float(z))


def rotation(matrix: Sequence[Sequence[float]], center: Sequence[float] = (0.0, 0.0, 0.0)) -> tuple[float, ...]:
    """The transform x -> R (x - center) + center."""
    return tuple(v for r, c in zip(matrix, center, strict=True) for v in (*map(float, r), c - sum(a * b for a, b in zip(r, center, strict=True))))


def turn(center: Sequence[float], direction: Sequence[float], angle: float) -> tuple[float, ...]:
    """The rotation by an angle about the axis through center along direction (of any length but 0)."""
    size = math.sqrt(sum(v * v for v in direction))
    if not size:
        raise ValueError("a rotation needs a direction")
    u = [v / size for v in direction]
    c, s = math.cos(angle), math.sin(angle)
    across = ((0.0, -u[2], u[1]), (u[2], 0.0, -u[0]), (-u[1], u[0], 0.0))
    return rotation([[c * (i == j) + s * across[i][j] + (1 - c) * u[i] * u[j] for j in range(3)] for i in range(3)], center)


def inverse(t: Sequence[float]) -> tuple[float, ...]:
    """Of a rigid transform."""
    r = [[t[4 * j + i] for j in range(3)] for i in range(3)]  # transposed
    return tuple(v for row in r for v in (*row, -sum(a * t[4 * j + 3] for j, a in enumerate(row))))


def composed(outer: Column, inner: Column) -> Column:
    """The transform that applies inner first."""
    o, i = (lambda k: F.get(outer, F.lit(k))), (lambda k: F.get(inner, F.lit(k)))
    out = []
    for r in range(3):
        for c in range(4):
            e = o(4 * r) * i(c) + o(4 * r + 1) * i(4 + c) + o(4 * r + 2) * i(8 + c)
            out.append(e + o(4 * r + 3) if c == 3 else e)
    return F.array(*out)


def moved(t: Column, p: Column) -> Column:
    """A point under a transform."""
    g = lambda k: F.get(t, F.lit(k))
    return F.struct(*[(g(4 * r) * p["x"] + g(4 * r + 1) * p["y"] + g(4 * r + 2) * p["z"] + g(4 * r + 3)).alias(a) for r, a in enumerate("xyz")])


def key_of(t: Column) -> Column:
    return F.transform(t, lambda x: F.round(x * 10.0**DIGITS).cast("long"))


def hops(interfaces: DataFrame, transforms: Mapping[int, Sequence[float]]) -> DataFrame:
    """(domain, ent, to_domain, to_ent, step) both ways: step moves what lies around the second entity to the first."""
    named = [k for k in transforms]
    lit = lambda t: F.array(*[F.lit(float(v)) for v in t])
    there, back = (F.lit(None).cast("array<double>") for _ in range(2))
    for k in named:
        there = F.when(F.col("interface") == k, lit(inverse(transforms[k]))).otherwise(there)
        back = F.when(F.col("interface") == k, lit(transforms[k])).otherwise(back)
    side = lambda a, b, t: interfaces.select(F.col(f"domain{a}").alias("domain"), F.col(f"gnum{a}").alias("ent"), F.col(f"domain{b}").alias("to_domain"), F.col(f"gnum{b}").alias("to_ent"), F.coalesce(t, F.raise_error("an interface has no transform")).alias("step"))
    return side(1, 2, there).unionByName(side(2, 1, back)).distinct()


def ghost_layers(cells: DataFrame, conn: DataFrame, interfaces: DataFrame, transforms: Mapping[int, Sequence[float]], depth: int = 1, most: int = 16) -> DataFrame:
    """cells: (part, domain, gnum); conn: (domain, src, dst), cells and the entities over which they are neighbours;
    interfaces: (interface, domain1, gnum1, domain2, gnum2) of such entities. (part, domain, gnum, transform, layer): what
    lies within depth steps of each part, layer 0 being its own cells, unmoved; transform: the 12 numbers of the move."""
    at, where = ["part", "domain", "gnum", "move"], ["part", "domain", "ent", "move"]
    links = materialise(conn.select("domain", F.col("src").alias("gnum"), F.abs("dst").alias("ent")).distinct())
    jumps = materialise(hops(interfaces, transforms))
    steps = materialise(jumps.select("step").distinct().withColumn("sid", F.monotonically_increasing_id()))
    jumps = materialise(jumps.join(F.broadcast(steps), "step").drop("step"))  # two steps an interface
    one = F.array(*[F.lit(v) for v in IDENTITY])
    moves = materialise(conn.sparkSession.range(1).select(named_by(one).alias("move"), one.alias("transform")))
    own = cells.select("part", "domain", "gnum").distinct()
    out = materialise(own.withColumn("move", named_by(one)).withColumn("layer", F.lit(0)))
    front, seen = out, None
    for layer in range(1, depth + 1):
        fresh = front.join(links, ["domain", "gnum"]).select(*where).distinct()
        fresh = materialise(fresh if seen is None else absent(fresh, seen, where))
        seen = fresh if seen is None else seen.unionByName(fresh)
        around = fresh
        for _ in range(most):
            far = fresh.join(jumps, ["domain", "ent"]).select("part", F.col("to_domain").alias("domain"), F.col("to_ent").alias("ent"), "move", "sid")
            far = materialise(far.distinct())
            if not far.limit(1).count():
                break
            moves, after = moved_on(moves, steps, far.select("move", "sid").distinct())
            far = far.join(F.broadcast(after), ["move", "sid"]).select("part", "domain", "ent", F.col("to").alias("move")).distinct()
            fresh = materialise(absent(far, seen, where))
            if not fresh.limit(1).count():
                break
            seen, around = seen.unionByName(fresh), around.unionByName(fresh)
        else:
            raise RuntimeError("the images of an entity did not end")
        reached = around.join(links, ["domain", "ent"]).select(*at).distinct()
        front = materialise(absent(reached, out, at).withColumn("layer", F.lit(layer)).select(*out.columns))
        out = out.unionByName(front)
    return out.join(F.broadcast(moves), "move").select("part", "domain", "gnum", "transform", "layer")


def named_by(transform: Column) -> Column:
    """A number for what `DIGITS` places of a transform tell: rows carry it instead of the transform. `moved_on` raises
    should two transforms ever share one."""
    return F.xxhash64(key_of(transform))


def moved_on(moves: DataFrame, steps: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """moves: (move, transform); pairs: (move, sid) of moves and steps (sid, step) to apply before. The moves with those that
    come of it, and (move, sid, to). The distinct moves are compositions of the interfaces' transforms: few, and broadcast."""
    met = pairs.join(F.broadcast(moves), "move").join(F.broadcast(steps), "sid").withColumn("transform", composed(F.col("transform"), F.col("step")))
    met = materialise(met.select("move", "sid", named_by(F.col("transform")).alias("to"), "transform"))
    every = moves.unionByName(met.select(F.col("to").alias("move"), "transform")).withColumn("key", key_of(F.col("transform")))
    if every.groupBy("move").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").limit(1).count():
        raise RuntimeError("two transforms have one number")
    new = met.groupBy(F.col("to").alias("move")).agg(F.first("transform").alias("transform"))
    return materialise(moves.unionByName(absent(new, moves, ["move"]).select("move", "transform"))), met.drop("transform")
