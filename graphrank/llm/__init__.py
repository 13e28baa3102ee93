"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from graphrank.llm.registry import ORACLES, QUERIES

from graphrank.llm import queries  # noqa: F401, I001

__all__ = ["ORACLES", "QUERIES"]
