"""Geometric predicates with exact signs, as column expressions that stay in the JVM.

Each predicate first compares the determinant in doubles with a bound of its rounding errors (Shewchuk's first stage).
Where the bound doesn't decide, the determinant is formed again as an expansion: an array of doubles, growing and not
overlapping, whose sum is the exact value. Sums and products of expansions are folds of two-sums and two-products, which
keep every rounding error. The sign of an expansion is that of its last number.

Signs are exact where no product over- or underflows: coordinates between about 1e-50 and 1e50 in size, and zero. A null
coordinate gives null, a coordinate that isn't finite gives 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.geometry import let

UNIT = 2.0**-53
#: First-stage error bounds, by predicate, in terms of the rounding unit u: (a + b u) u times the sum of sizes.
BOUNDS = {"orient2d": (3, 16), "orient3d": (7, 56), "in_circle": (10, 96), "in_sphere": (16, 224)}


def empty() -> Column:
    return F.slice(F.array(F.lit(0.0)), 1, 0)


def two_sum(a: Column, b: Column) -> Column:
    """(high, low): the rounded sum and what it lost."""
    return let(F.struct(a.alias("a"), b.alias("b"), (a + b).alias("s")), lambda t: let(t["s"] - t["a"], lambda c: F.struct(t["s"].alias("high"), ((t["a"] - (t["s"] - c)) + (t["b"] - c)).alias("low"))))


def halves(a: Column) -> Column:
    """(high, low): two numbers of 26 bits whose sum is a."""
    return let(a * F.lit(134217729.0), lambda c: let(c - (c - a), lambda h: F.struct(h.alias("high"), (a - h).alias("low"))))


def two_product(a: Column, b: Column) -> Column:
    """The rounded product and what it lost, as (low, high)."""

    def of(t: Column) -> Column:
        p, q = halves(t["a"]), halves(t["b"])
        lost = lambda x: (x["p"]["low"] * x["q"]["low"]) - (((x["s"] - x["p"]["high"] * x["q"]["high"]) - x["p"]["low"] * x["q"]["high"]) - x["p"]["high"] * x["q"]["low"])
        return let(F.struct(p.alias("p"), q.alias("q"), (t["a"] * t["b"]).alias("s")), lambda x: F.array(lost(x), x["s"]))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def grown(e: Column, b: Column) -> Column:
    """The expansion e plus a double; zeros are left out."""

    def step(acc: Column, x: Column) -> Column:
        return let(two_sum(acc["q"], x), lambda t: F.struct(t["high"].alias("q"), F.when(t["low"] != 0, F.concat(acc["h"], F.array(t["low"]))).otherwise(acc["h"]).alias("h")))

    last = lambda acc: F.when(acc["q"] != 0, F.concat(acc["h"], F.array(acc["q"]))).otherwise(acc["h"])
    return F.aggregate(e, F.struct(b.alias("q"), empty().alias("h")), step, last)


def compressed(e: Column) -> Column:
    """The same value in as few numbers as hold it, so that later products stay short."""

    def carried(x: Column) -> Column:
        """Fold of x, from its first element on, into (kept numbers, rest): rounded sums move on, what they lose stays."""

        def step(acc: Column, v: Column) -> Column:
            return let(two_sum(acc["q"], v), lambda t: F.struct(t["high"].alias("q"), F.when(t["low"] != 0, F.concat(acc["h"], F.array(t["low"]))).otherwise(acc["h"]).alias("h")))

        return F.aggregate(x, F.struct(F.lit(0.0).alias("q"), empty().alias("h")), step, lambda acc: F.when(acc["q"] != 0, F.concat(acc["h"], F.array(acc["q"]))).otherwise(acc["h"]))

    def falling(x: Column) -> Column:
        """Fold of x from its largest number down: what a sum loses goes on, the sum stays."""

        def step(acc: Column, v: Column) -> Column:
            return let(two_sum(acc["q"], v), lambda t: F.when(t["low"] != 0, F.struct(t["low"].alias("q"), F.concat(acc["h"], F.array(t["high"])).alias("h"))).otherwise(F.struct(t["high"].alias("q"), acc["h"].alias("h"))))

        return F.aggregate(F.reverse(x), F.struct(F.lit(0.0).alias("q"), empty().alias("h")), step, lambda acc: F.when(acc["q"] != 0, F.concat(acc["h"], F.array(acc["q"]))).otherwise(acc["h"]))

    return carried(F.reverse(falling(e)))


def plus(e: Column, f: Column) -> Column:
    return F.aggregate(f, e, grown)


def minus(e: Column, f: Column) -> Column:
    return plus(e, F.transform(f, lambda x: -x))


def times(e: Column, f: Column) -> Column:
    return F.aggregate(F.flatten(F.transform(f, lambda y: F.flatten(F.transform(e, lambda x: two_product(x, y))))), empty(), grown)


def difference(a: Column, b: Column) -> Column:
    """a - b of two doubles as an expansion."""
    return let(two_sum(a, -b), lambda t: F.filter(F.array(t["low"], t["high"]), lambda x: x != 0))


def expansion_sign(e: Column) -> Column:
    return F.when(F.size(e) == 0, 0).otherwise(F.signum(F.element_at(e, -1))).cast("int")


def chained(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body over a struct of values, each computed once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def decided(name: str, value: Column, size: Column, points: list[Column], exact: Callable[[Column], Column]) -> Column:
    """The sign of value where its error bound lets it stand, else that of the exact expansion."""
    a, b = BOUNDS[name]
    finite = F.lit(True)
    for p in points:
        finite = finite & (p < float("inf")) & (p > float("-inf"))

    def of(t: Column) -> Column:
        return F.when(t["v"].isNull(), F.lit(None)).when(~finite, 0).when(F.abs(t["v"]) > t["s"] * ((a + b * UNIT) * UNIT), F.signum(t["v"])).otherwise(exact(t)).cast("int")

    return let(F.struct(value.alias("v"), size.alias("s")), of)


def offsets(points: list[Column], origin: Column, axes: str) -> dict[str, Column]:
    return {f"{k}{n}": p[k] - origin[k] for n, p in enumerate(points) for k in axes}


def exact_offsets(points: list[Column], origin: Column, axes: str) -> dict[str, Column]:
    return {f"{k}{n}": difference(p[k], origin[k]) for n, p in enumerate(points) for k in axes}


def coordinates(points: list[Column], axes: str) -> list[Column]:
    return [p[k] for p in points for k in axes]


def orient2d_sign(a: Column, b: Column, c: Column) -> Column:
    """1 if a, b, c turn left, -1 if they turn right, 0 on one line."""

    def doubles(t: Column) -> Column:
        left, right = t["x0"] * t["y1"], t["y0"] * t["x1"]
        return decided("orient2d", left - right, F.abs(left) + F.abs(right), coordinates([a, b, c], "xy"), lambda _: exact())

    def exact() -> Column:
        return chained(exact_offsets([a, b], c, "xy"), lambda t: expansion_sign(minus(times(t["x0"], t["y1"]), times(t["y0"], t["x1"]))))

    return chained(offsets([a, b], c, "xy"), doubles)


def minors(t: Column, axes: tuple[str, str], pairs: list[tuple[int, int]], mul, sub) -> dict[str, Column]:
    """The 2 x 2 determinants of pairs of offsets."""
    u, v = axes
    return {f"m{i}{j}": sub(mul(t[f"{u}{i}"], t[f"{v}{j}"]), mul(t[f"{v}{i}"], t[f"{u}{j}"])) for i, j in pairs}


def plain(op: str):
    return {"mul": lambda a, b: a * b, "sub": lambda a, b: a - b, "add": lambda a, b: a + b}[op]


def sizes_of_minors(t: Column, axes: tuple[str, str], pairs: list[tuple[int, int]]) -> dict[str, Column]:
    u, v = axes
    return {f"m{i}{j}": F.abs(t[f"{u}{i}"] * t[f"{v}{j}"]) + F.abs(t[f"{v}{i}"] * t[f"{u}{j}"]) for i, j in pairs}


RING3 = [(1, 2), (2, 0), (0, 1)]


def orient3d_sign(a: Column, b: Column, c: Column, d: Column) -> Column:
    """1 if d lies below the plane of a, b, c, seen from where they turn left; -1 above it; 0 on it."""
    points = [a, b, c]

    def doubles(t: Column) -> Column:
        m, s = minors(t, ("x", "y"), RING3, plain("mul"), plain("sub")), sizes_of_minors(t, ("x", "y"), RING3)
        value = t["z0"] * m["m12"] + t["z1"] * m["m20"] + t["z2"] * m["m01"]
        size = F.abs(t["z0"]) * s["m12"] + F.abs(t["z1"]) * s["m20"] + F.abs(t["z2"]) * s["m01"]
        return decided("orient3d", value, size, coordinates([*points, d], "xyz"), lambda _: exact())

    def exact() -> Column:
        return chained(exact_offsets(points, d, "xyz"), lambda t: chained(minors(t, ("x", "y"), RING3, times, minus), lambda m: expansion_sign(plus(plus(times(m["m12"], t["z0"]), times(m["m20"], t["z1"])), times(m["m01"], t["z2"])))))

    return chained(offsets(points, d, "xyz"), doubles)


def in_circle_sign(a: Column, b: Column, c: Column, d: Column) -> Column:
    """1 if d lies inside the circle of a, b, c, which turn left; -1 outside; 0 on it. Turned around for a right turn."""
    points = [a, b, c]

    def doubles(t: Column) -> Column:
        m, s = minors(t, ("x", "y"), RING3, plain("mul"), plain("sub")), sizes_of_minors(t, ("x", "y"), RING3)
        lift = [t[f"x{k}"] * t[f"x{k}"] + t[f"y{k}"] * t[f"y{k}"] for k in range(3)]
        value = lift[0] * m["m12"] + lift[1] * m["m20"] + lift[2] * m["m01"]
        size = lift[0] * s["m12"] + lift[1] * s["m20"] + lift[2] * s["m01"]
        return decided("in_circle", value, size, coordinates([*points, d], "xy"), lambda _: exact())

    def exact() -> Column:
        def of(t: Column) -> Column:
            lifts = {f"l{k}": plus(times(t[f"x{k}"], t[f"x{k}"]), times(t[f"y{k}"], t[f"y{k}"])) for k in range(3)}
            return chained({**minors(t, ("x", "y"), RING3, times, minus), **lifts}, lambda m: expansion_sign(plus(plus(times(m["m12"], m["l0"]), times(m["m20"], m["l1"])), times(m["m01"], m["l2"]))))

        return chained(exact_offsets(points, d, "xy"), of)

    return chained(offsets(points, d, "xy"), doubles)


#: The four determinants of three offsets each: left-out point, its sign in the expansion, and the three others.
TRIPLES = ((0, 1, (1, 2, 3)), (1, -1, (0, 2, 3)), (2, 1, (0, 1, 3)), (3, -1, (0, 1, 2)))
PAIRS4 = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def in_sphere_sign(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """1 if e lies inside the sphere of a, b, c, d, where orient3d_sign(a, b, c, d) is 1; -1 outside; 0 on it. Turned
    around where it is -1."""
    points = [a, b, c, d]

    def doubles(t: Column) -> Column:
        m, s = minors(t, ("x", "y"), PAIRS4, plain("mul"), plain("sub")), sizes_of_minors(t, ("x", "y"), PAIRS4)
        value, size = F.lit(0.0), F.lit(0.0)
        for k, sign, (p, q, r) in TRIPLES:
            lift = t[f"x{k}"] * t[f"x{k}"] + t[f"y{k}"] * t[f"y{k}"] + t[f"z{k}"] * t[f"z{k}"]
            value = value + sign * lift * (t[f"z{p}"] * m[f"m{q}{r}"] - t[f"z{q}"] * m[f"m{p}{r}"] + t[f"z{r}"] * m[f"m{p}{q}"])
            size = size + lift * (F.abs(t[f"z{p}"]) * s[f"m{q}{r}"] + F.abs(t[f"z{q}"]) * s[f"m{p}{r}"] + F.abs(t[f"z{r}"]) * s[f"m{p}{q}"])
        return decided("in_sphere", -value, size, coordinates([*points, e], "xyz"), lambda _: exact())

    def exact() -> Column:
        def with_minors(t: Column) -> Column:
            return chained({**minors(t, ("x", "y"), PAIRS4, times, minus), "t": t}, with_triples)

        def with_triples(m: Column) -> Column:
            t, parts = m["t"], {}
            for k, _, (p, q, r) in TRIPLES:
                det = plus(minus(times(m[f"m{q}{r}"], t[f"z{p}"]), times(m[f"m{p}{r}"], t[f"z{q}"])), times(m[f"m{p}{q}"], t[f"z{r}"]))
                lift = plus(plus(times(t[f"x{k}"], t[f"x{k}"]), times(t[f"y{k}"], t[f"y{k}"])), times(t[f"z{k}"], t[f"z{k}"]))
                parts[f"p{k}"] = chained({"d": compressed(det), "l": compressed(lift)}, lambda x: times(x["d"], x["l"]))
            return chained(parts, lambda x: -expansion_sign(plus(minus(x["p0"], x["p1"]), minus(x["p2"], x["p3"]))))

        return chained(exact_offsets(points, e, "xyz"), with_minors)

    return chained(offsets(points, e, "xyz"), doubles)
