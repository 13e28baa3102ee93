"""Ranks, cuts and running sums that never put one whole group into one task.

A window over a handful of groups (three relations, one model) or without any
group runs in that many tasks. The helpers here split the order axis first,
carry totals between the pieces, and only then use windows inside a piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrank.plans.lineage import materialize, shuffle_partitions


def stable_hash(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``|``: the same order under any partitioning or retry."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def hash_number(digest: Column, start: int = 1, digits: int = 15) -> Column:
    """Non-negative long from ``digits`` hex digits of a digest."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter is pushed below the shuffle (each task keeps one row per
    key), so a key with a third of all rows costs no more than any other.
    """
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", ranked).where("_rn = 1").drop("_rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key with their rank; at most ``n`` rows per key and task are shuffled."""
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, numbered).where(F.col(rank) <= n)


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "idx"
) -> DataFrame:
    """Add 0, 1, 2, ... per key in ``order``, over all tasks.

    Rows are range-partitioned by key and order and stored, so the position in
    a task is fixed; the rows of earlier tasks are added as an offset. The
    offset table has one row per key and task.
    """
    placed = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_row_pos", F.monotonically_increasing_id())
    )
    part = F.shiftright("_row_pos", 33).alias("_row_part")
    sizes = placed.groupBy(*keys, part).agg(
        F.min("_row_pos").alias("_row_first"), F.count(F.lit(1)).alias("_row_n")
    )
    earlier = Window.partitionBy(*keys).orderBy("_row_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_row_part", "_row_first", F.coalesce(F.sum("_row_n").over(earlier), F.lit(0)).alias("_row_before")
    )
    return (
        placed.withColumn("_row_part", F.shiftright("_row_pos", 33))
        .join(offsets, [*keys, "_row_part"])
        .withColumn(name, F.col("_row_pos") - F.col("_row_first") + F.col("_row_before"))
        .drop("_row_pos", "_row_part", "_row_first", "_row_before")
    )


def with_running_sums(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]
) -> DataFrame:
    """Add ``before_<value>``: the sum over rows of the key with a smaller ``order``.

    ``df`` has one row per key and order value. The order axis is cut at
    approximate quantiles (their number is the number of shuffle partitions),
    so a key with many rows is spread over many windows.
    """
    parts = max(2, shuffle_partitions(df.sparkSession))
    quantiles = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)
    splits = [float("-inf"), *sorted({q for q in quantiles if abs(q) < float("inf")}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order, outputCol="_piece").transform(df)
    piece = [*keys, "_piece"]
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*piece).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    carried = totals.select(
        *piece, *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_c_{v}") for v in values]
    )
    within = Window.partitionBy(*piece).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(carried, piece)
    for v in values:
        out = out.withColumn(f"before_{v}", F.col(f"_c_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)))
    return out.drop("_piece", *[f"_c_{v}" for v in values])
