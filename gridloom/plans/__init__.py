"""Registered queries."""

from gridloom.plans import meshes, pieces, queries

__all__ = ["meshes", "pieces", "queries"]
