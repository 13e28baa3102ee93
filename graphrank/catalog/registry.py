"""Register of checkable queries: a Spark job and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphrank.plans.binding import Sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable:
    """Register the decorated function of :class:`Sources`; ``covers`` lists survey operators."""

    def register(function: Callable[[Sources], DataFrame]) -> Callable[[Sources], DataFrame]:
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(Sources(spark, sf_dir))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
