"""Operators on global ids, connectivities, meshes and point clouds."""
