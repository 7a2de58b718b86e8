"""Lagrange shape functions of elements of any order, and the orders of their nodes.

The reference element lies in the unit cube: u, v, w from 0 to 1, simplices where their sum is at most 1. Nodes stand at
multiples of 1 / order. A node ordering lists their multiples; "lattice" has u fastest, then v, then w, and "vtk" at order
1 is that of this library's elements (a base in turn, then what lies across from it). Others can be registered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import product

import numpy as np

INSIDE = {
    "edge": lambda i, p: i[1] == i[2] == 0, "triangle": lambda i, p: i[0] + i[1] <= p and i[2] == 0, "quad": lambda i, p: i[2] == 0,
    "tetra": lambda i, p: sum(i) <= p, "prism": lambda i, p: i[0] + i[1] <= p, "hexa": lambda i, p: True,
}
DIMENSION = {"edge": 1, "triangle": 2, "quad": 2, "tetra": 3, "pyramid": 3, "prism": 3, "hexa": 3}
#: Corners of first-order elements in this library's order.
CORNERS = {
    "edge": ((0, 0, 0), (1, 0, 0)), "triangle": ((0, 0, 0), (1, 0, 0), (0, 1, 0)), "quad": ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)),
    "tetra": ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)), "pyramid": ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1)),
    "prism": ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)),
    "hexa": ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)),
}
ORDERINGS: dict[tuple[str, str, int], list[tuple[int, int, int]]] = {}


def lattice(kind: str, order: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for k, j, i in product(range(order + 1), repeat=3) if INSIDE[kind]((i, j, k), order)]


def register_ordering(name: str, kind: str, order: int, nodes: Sequence[Sequence[int]]) -> None:
    """nodes: the multiples of 1 / order along u, v and w, node by node."""
    held = [tuple(map(int, n)) for n in nodes]
    if sorted(held) != sorted(lattice(kind, order)):
        raise ValueError("an ordering names each node of the element once")
    ORDERINGS[name, kind, order] = held
    shape.cache_clear()


def nodes_of(kind: str, order: int, ordering: str) -> list[tuple[int, int, int]]:
    if (ordering, kind, order) in ORDERINGS:
        return ORDERINGS[ordering, kind, order]
    if order == 1 and ordering == "vtk":
        return list(CORNERS[kind])
    if ordering == "lattice" and kind in INSIDE:
        return lattice(kind, order)
    raise ValueError(f"no ordering {ordering} of {kind} of order {order}")


class Shape:
    """Values and derivatives of an element's shape functions; pyramids are of order 1, with a rational function."""

    def __init__(self, kind: str, order: int, ordering: str):
        if kind == "pyramid" and order > 1:
            raise ValueError("pyramids are of order 1")
        self.kind, self.order, self.dim = kind, order, DIMENSION[kind]
        self.nodes = np.array(nodes_of(kind, order, ordering), np.float64) / order
        self.powers = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)] if kind == "pyramid" else lattice(kind, order)
        self.inverse = np.linalg.inv(self.terms(self.nodes)[0])
        #: how far values can reach beyond the nodes' own: the largest sum of the functions' sizes, on a fine grid, and a bit
        fine = np.array(list(product(np.linspace(0, 1, 6 * order + 1), repeat=3)))
        fine = fine[self.inside(fine, 1e-12)]
        self.reach = float(np.abs(self.values(fine)[0]).sum(axis=1).max()) * 1.05

    def terms(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Monomials at points (count, 3), and their derivatives (count, terms, 3)."""
        value, slope = [], []
        for powers in self.powers:
            factors = [x[:, a] ** n for a, n in enumerate(powers)]
            value.append(factors[0] * factors[1] * factors[2])
            own = []
            for a, n in enumerate(powers):
                d = n * x[:, a] ** max(n - 1, 0) if n else np.zeros(len(x))
                own.append(d * np.prod([factors[b] for b in range(3) if b != a], axis=0))
            slope.append(np.stack(own, axis=1))
        if self.kind == "pyramid":
            rest = 1 - x[:, 2]
            safe = np.where(np.abs(rest) > 1e-12, rest, 1.0)
            top = np.abs(rest) <= 1e-12
            value.append(np.where(top, 0, x[:, 0] * x[:, 1] / safe))
            slope.append(np.where(top[:, None], 0, np.stack([x[:, 1] / safe, x[:, 0] / safe, x[:, 0] * x[:, 1] / safe**2], axis=1)))
        return np.stack(value, axis=1), np.stack(slope, axis=1)

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shape functions at points (count, 3), and their derivatives (count, nodes, 3)."""
        value, slope = self.terms(x)
        return value @ self.inverse, np.einsum("kta,tn->kna", slope, self.inverse)

    def inside(self, x: np.ndarray, slack: float) -> np.ndarray:
        u, v, w = x.T
        low = (x[:, : self.dim] >= -slack).all(axis=1)
        most = {"edge": u, "triangle": u + v, "quad": np.maximum(u, v), "tetra": u + v + w, "pyramid": np.maximum(u, v) + w, "prism": np.maximum(u + v, w), "hexa": np.maximum(np.maximum(u, v), w)}[self.kind]
        return low & (most <= 1 + slack)


@lru_cache(64)
def shape(kind: str, order: int, ordering: str) -> Shape:
    return Shape(kind, order, ordering)
