"""Mesh generators and files."""
