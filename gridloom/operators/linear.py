"""Small dense linear systems, one a row: elimination with pivots, and singular values by one-sided Jacobi rotations.

Matrices are arrays of doubles, row by row. A table function takes an Arrow batch, puts systems of equal shape side by
side, and runs each step of the method for all of them at once.

Defined results: a matrix or right side that is null, of another length, or with a null or non-finite number gives nulls;
a singular system (a pivot under `TOLERANCE` of the largest entry of the matrix) has a null x and the number of pivots found
as its rank; least squares take the shortest of the best solutions, with singular values under `TOLERANCE` of the largest
as zero; repeated rows give equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, SWEEPS = 1e-12, 60


def eliminated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions (count, n) of (count, n, n) systems and their ranks; rows of rank under n have no meaning."""
    count, n, _ = a.shape
    m = np.concatenate([a, b[:, :, None]], axis=2)
    least, rank, at = TOLERANCE * np.abs(a).max(axis=(1, 2), initial=0), np.zeros(count, np.int64), np.arange(count)
    for k in range(n):
        # a column without a pivot leaves its row to the next column
        below = np.arange(n)[None, :] >= rank[:, None]
        size = np.where(below, np.abs(m[:, :, k]), -1)
        pivot = size.argmax(axis=1)
        fine = (size[at, pivot] > least) & (rank < n)
        if not fine.any():
            continue
        rows, r, p = at[fine], rank[fine], pivot[fine]
        m[rows, r], m[rows, p] = m[rows, p].copy(), m[rows, r].copy()
        lead = m[rows, r] / m[rows, r, k][:, None]
        factor = m[rows, :, k].copy()
        factor[np.arange(len(rows)), r] = 0
        m[rows] -= factor[:, :, None] * lead[:, None, :]
        m[rows, r] = lead
        rank[fine] += 1
    return m[:, :, n], rank


def rotated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (count, m, n) matrices u (count, m, n), singular values (count, n) from the largest down, and v (count, n, n)."""
    count, _, n = a.shape
    u, v = a.astype(np.float64).copy(), np.broadcast_to(np.eye(n), (count, n, n)).copy()
    for _ in range(SWEEPS):
        moved = False
        for p in range(n):
            for q in range(p + 1, n):
                x, y = u[:, :, p], u[:, :, q]
                alpha, beta, gamma = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
                turn = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
                if not turn.any():
                    continue
                moved = True
                zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
                t = np.where(turn, np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
                c = (1 / np.sqrt(1 + t * t))[:, None]
                s = c * t[:, None]
                for w in (u, v):
                    w[:, :, p], w[:, :, q] = c * w[:, :, p] - s * w[:, :, q], s * w[:, :, p] + c * w[:, :, q]
        if not moved:
            break
    size = np.sqrt((u * u).sum(axis=1))
    order = np.argsort(-size, axis=1, kind="stable")
    size, u, v = np.take_along_axis(size, order, 1), np.take_along_axis(u, order[:, None, :], 2), np.take_along_axis(v, order[:, None, :], 2)
    return u / np.where(size > 0, size, 1)[:, None, :], size, v


def least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shortest least-squares solutions (count, n) and the ranks."""
    u, s, v = rotated(a)
    held = s > TOLERANCE * s.max(axis=1, initial=0)[:, None]
    weights = np.einsum("kmn,km->kn", u, b) / np.where(held, s, 1) * held
    return np.einsum("kij,kj->ki", v, weights), held.sum(axis=1)


def numbers(values: list | None, size: int) -> bool:
    return values is not None and len(values) == size and all(x is not None and np.isfinite(x) for x in values)


def each_system(df: DataFrame, rows: int, columns: int, method: Callable, schema: str, names: list[str], kinds: list[pa.DataType], right: bool = True) -> DataFrame:
    """method over the whole systems of a batch; its results, a list a column, in the rows' places."""

    def run(batches):
        for batch in batches:
            a = batch.column(1).to_pylist()
            b = batch.column(2).to_pylist() if right else [[]] * len(a)
            whole = [k for k in range(len(a)) if numbers(a[k], rows * columns) and (not right or numbers(b[k], rows))]
            out: list[list] = [[None] * len(a) for _ in names]
            if whole:
                found = method(np.array([a[k] for k in whole], np.float64).reshape(-1, rows, columns), np.array([b[k] for k in whole], np.float64).reshape(len(whole), -1))
                for column, values in zip(out, found, strict=True):
                    for k, x in zip(whole, values, strict=True):
                        column[k] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["gnum", *names])

    typed = df.select(F.col("gnum").cast("long"), F.col("a").cast("array<double>"), *([F.col("b").cast("array<double>")] if right else []))
    return typed.mapInArrow(run, f"gnum long, {schema}")


VECTOR = pa.list_(pa.float64())


def solve(df: DataFrame, n: int) -> DataFrame:
    """df: (gnum, a of n * n, b of n). (gnum, x, rank)."""

    def method(a, b):
        x, rank = eliminated(a, b)
        return [r.tolist() if k == n else None for r, k in zip(x, rank, strict=True)], rank.tolist()

    return each_system(df, n, n, method, "x array<double>, rank int", ["x", "rank"], [VECTOR, pa.int32()])


def least_squares(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """df: (gnum, a of rows * columns, b of rows). (gnum, x, rank, residual): the length of a x - b."""

    def method(a, b):
        x, rank = least(a, b)
        rest = np.sqrt(((np.einsum("kij,kj->ki", a, x) - b) ** 2).sum(axis=1))
        return x.tolist(), rank.tolist(), rest.tolist()

    return each_system(df, rows, columns, method, "x array<double>, rank int, residual double", ["x", "rank", "residual"], [VECTOR, pa.int32(), pa.float64()])


def singular_values(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """df: (gnum, a). (gnum, u, s, v): a = u diag(s) v^T, u and v row by row, s from the largest down."""

    def method(a, _):
        u, s, v = rotated(a)
        return u.reshape(len(a), -1).tolist(), s.tolist(), v.reshape(len(a), -1).tolist()

    return each_system(df, rows, columns, method, "u array<double>, s array<double>, v array<double>", ["u", "s", "v"], [VECTOR] * 3, right=False)
