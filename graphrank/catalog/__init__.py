"""Registered queries with their SQL oracles."""

from graphrank.catalog.registry import COVERS, ORACLES, QUERIES

from graphrank.catalog import columns, graphs, links, ranking, scoring, training  # noqa: F401, I001

__all__ = ["COVERS", "ORACLES", "QUERIES"]
