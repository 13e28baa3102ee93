"""Idempotent upsert of nodes and edges, in batch and from a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from graphrank.functions.columns import unsafe_names
from graphrank.operators.graph import unique_key_violations

NODE_KEYS = ("node_type", "node_id")
EDGE_KEYS = ("source_type", "source_id", "edge_type", "target_type", "target_id")


def merge(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, one per key; a property is overwritten only by a value that is not null."""
    columns = [*keys, *sorted({c for c in [*stored.columns, *incoming.columns] if c not in keys})]
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in stored.columns if c not in keys])
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c not in keys])
    both = old.join(new, list(keys), "full_outer")

    def value(name: str):
        sides = [F.col(s + name) for s in ("_new_", "_old_") if s + name in both.columns]
        return F.coalesce(*sides).alias(name)

    return both.select(*keys, *[value(c) for c in columns if c not in keys])


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key from a batch with repeats: per property the last value that is not null."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*order)
    return rows.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
    )


def merge_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    check_names(incoming, "node_type")
    return merge(stored, incoming, NODE_KEYS)


def merge_edges(stored: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upsert of edges; an incoming edge counts only if both of its ends exist."""
    check_names(incoming, "edge_type")
    keys = nodes.select(*NODE_KEYS)
    linked = incoming.join(
        keys.withColumnsRenamed({"node_type": "source_type", "node_id": "source_id"}),
        ["source_type", "source_id"], "left_semi",
    ).join(
        keys.withColumnsRenamed({"node_type": "target_type", "node_id": "target_id"}),
        ["target_type", "target_id"], "left_semi",
    )
    return merge(stored, linked, EDGE_KEYS)


def check_names(rows: DataFrame, column: str) -> None:
    """Raise when a label or relation name has characters that names may not have."""
    found = unsafe_names(rows, column)
    bad = [r[0] for r in found.limit(20).collect()]
    if bad:
        raise ValueError(f"{found.count()} unsafe names in {column}, among them {bad}")


def assert_unique_keys(nodes: DataFrame) -> None:
    found = unique_key_violations(nodes)
    repeated = found.limit(20).collect()
    if repeated:
        raise ValueError(f"{found.count()} node keys repeat, among them {[tuple(r) for r in repeated]}")


def _dated(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key and property ``_at_<property>``: struct of the order and of its last value that is not null."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(c).alias("v")))).alias(f"_at_{c}")
        for c in rest
    ])


def read_upserted(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A version of the upserted table with its properties as columns."""
    stored = spark.read.parquet(f"{folder}/version={version}")
    return stored.select(*[F.col(f"{c}.v").alias(c.removeprefix("_at_")) if c.startswith("_at_") else F.col(c) for c in stored.columns])


def stream_upsert(
    stream: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, start: DataFrame | None = None
) -> DataStreamWriter:
    """Stream writer that merges each micro-batch into a table kept as versions below ``folder``.

    Version ``n+1`` holds version ``n`` merged with batch ``n``; ``start`` is a table in the columns of the stream that
    is there before the first batch. Each property is stored with the order values it came with, so a row that comes
    late never replaces a later one. A batch that is retried rewrites the same version from the same input, so
    the upsert stays idempotent after a failure. Read it with :func:`read_upserted`.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = _dated(batch, keys, order)
        stored = None
        if batch_id > 0:
            stored = batch.sparkSession.read.parquet(f"{folder}/version={batch_id - 1}")
        elif start is not None:
            stored = _dated(start, keys, order)
        if stored is not None:
            dated = [c for c in fresh.columns if c not in keys]
            fresh = stored.unionByName(fresh).groupBy(*keys).agg(*[F.max(c).alias(c) for c in dated])
        fresh.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
