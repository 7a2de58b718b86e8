"""Space-filling-curve keys as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(x: Column, low, high, level: int) -> Column:
    """The cell 0 .. 2**level - 1 of a coordinate; the upper bound falls in the last cell, a flat axis in cell 0."""
    n = 1 << level
    width = F.lit(high) - F.lit(low)
    cell = F.floor((x - F.lit(low)) / F.when(width == 0, F.lit(1.0)).otherwise(width) * n)
    return F.least(F.greatest(cell, F.lit(0)), F.lit(n - 1)).cast("long")


def spread(x: Column, gap: int, level: int) -> Column:
    """Bit i of x moved to bit i * gap."""
    out = F.lit(0).cast("long")
    for i in range(level):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), i * gap))
    return out


def morton(cells: Sequence[Column], level: int) -> Column:
    """Interleaved bits of grid cells, the first axis in the highest place. At most 63 bits in all."""
    if level * len(cells) > 63:
        raise ValueError("level * axes must be at most 63")
    d, out = len(cells), F.lit(0).cast("long")
    for k, c in enumerate(cells):
        out = out.bitwiseOR(F.shiftleft(spread(c.cast("long"), d, level), d - 1 - k))
    return out


def hilbert2(x: Column, y: Column, level: int) -> Column:
    """Distance along the two-dimensional Hilbert curve, from the highest bit down, as a fold over the levels."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, size: Column) -> Column:
        rx, ry = (s["x"] >= size).cast("long"), (s["y"] >= size).cast("long")
        fx, fy = s["x"] - rx * size, s["y"] - ry * size
        flip = (ry == 0) & (rx == 1)
        gx, gy = F.when(flip, size - 1 - fx).otherwise(fx), F.when(flip, size - 1 - fy).otherwise(fy)
        d = s["d"] + (rx * 3).bitwiseXOR(ry) * size * size
        return F.struct(F.when(ry == 0, gy).otherwise(gx).alias("x"), F.when(ry == 0, gx).otherwise(gy).alias("y"), d.alias("d"))

    sizes = F.array(*[F.lit(1 << i).cast("long") for i in range(level - 1, -1, -1)])
    return F.aggregate(sizes, start, step, lambda s: s["d"])


def hilbert(cells: Sequence[Column], level: int) -> Column:
    """Distance along the Hilbert curve of any number of axes, level * axes at most 63, by rotations and reflections from
    the highest bit down, a Gray code across the axes, and interleaved bits."""
    d = len(cells)
    if level * d > 63:
        raise ValueError("level * axes must be at most 63")
    name = [f"x{k}" for k in range(d)]
    make = lambda values: F.struct(*[v.alias(n) for n, v in zip(name, values, strict=True)])
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    xor = lambda a, b: a.bitwiseXOR(b)

    def turned(k: int, q: Column):
        """Axis k of a cell at the bit q: a set bit flips the lower bits of the first axis, another swaps them with its own."""

        def of(s: Column) -> Column:
            x = [s[n] for n in name]
            p = q - 1
            on = x[k].bitwiseAND(q) != 0
            t = xor(x[0], x[k]).bitwiseAND(p)
            first = F.when(on, xor(x[0], p)).otherwise(xor(x[0], t))
            own = F.when(on, x[k]).otherwise(xor(x[k], t))
            return make([first if i == 0 else own if i == k else x[i] for i in range(d)])

        return of

    def step(s: Column, q: Column) -> Column:
        for k in range(d):
            s = let(s, turned(k, q))
        return s

    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(level - 1, 0, -1)]) if level > 1 else F.expr("cast(array() as array<bigint>)")
    cell = F.aggregate(bits, make([c.cast("long") for c in cells]), step)

    def gray(s: Column) -> Column:
        x = [s[n] for n in name]
        for k in range(1, d):
            x[k] = xor(x[k], x[k - 1])
        flips = F.aggregate(bits, F.lit(0).cast("long"), lambda t, q: F.when(x[-1].bitwiseAND(q) != 0, xor(t, q - 1)).otherwise(t))
        return let(flips, lambda t: morton([xor(v, t) for v in x], level))

    return let(cell, gray)
