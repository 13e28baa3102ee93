"""Exact ranks among all tails of a type, for scorers that are a product of two vectors.

No heads x tails rows are made. Positives and tails are packed into blocks; a task multiplies a block of query vectors with a block of tail
vectors and puts out, for each positive, how many tails score higher and how many the same. Scores near that of the
positive are computed again row by row, in one fixed order of summation, so equal vectors tie whatever
block they are in. Known links are then taken off with a histogram of their scores per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.operators.evaluate import TRIPLE
from graphrank.operators.ordering import dense_index, with_running_sums
from graphrank.plans.lineage import materialize

_QUERY = ["head", "relation"]
#: Positives and tails of a block. A block of positives is copied to each block of tails, so the latter are large; a task
#: multiplies ``_SLICE`` of its tails at a time.
BLOCK, TAILS, _SLICE = 512, 8192, 512


def _product(a: str, b: str) -> Column:
    """Dot product of two vector columns; the order of summation depends on the width only."""
    @F.pandas_udf("double")
    def product(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series((np.stack(x.to_numpy()).astype(float) * np.stack(y.to_numpy()).astype(float)).sum(axis=-1))

    return product(a, b)


def _packed(rows: DataFrame, keys: list[str], number: str, columns: list[str], size: int) -> DataFrame:
    """Blocks of ``size`` rows by number: ``(keys, _block, _rows)``, rows in order."""
    block = F.expr(f"{number} div {size}").alias("_block")
    return rows.select(*keys, block, F.struct(number, *columns).alias("_row")).groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))


def _counts(met: DataFrame) -> DataFrame:
    """(_p, greater, ties) of each pair of blocks (_mine, _tails)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(positive, greater, ties) of each pair of blocks."""
        for batch in batches:
            for mine, theirs in zip(batch.column(0), batch.column(1), strict=True):
                queries, tails = mine.values, theirs.values

                def matrix(part: pa.StructArray) -> np.ndarray:
                    return part.field("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)

                q = matrix(queries)
                own_score = queries.field("score").to_numpy(zero_copy_only=False)[:, None]
                own_pos = queries.field("_own").to_numpy(zero_copy_only=False)[:, None]
                above, same = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
                for start in range(0, len(tails), _SLICE):
                    part = tails.slice(start, _SLICE)
                    t = matrix(part)
                    product = q @ t.T
                    room = 1e-9 * (np.abs(q) @ np.abs(t).T + np.abs(own_score))
                    near = np.abs(product - own_score) <= room
                    greater = (product > own_score) & ~near
                    ties = np.zeros_like(near)
                    i, j = np.nonzero(near)
                    again = (q[i] * t[j]).sum(axis=-1)
                    greater[i, j] = again > own_score[i, 0]
                    ties[i, j] = again == own_score[i, 0]
                    own = own_pos == part.field("_pos").to_numpy(zero_copy_only=False)[None, :]
                    above += (greater & ~own).sum(axis=1)
                    same += (ties & ~own).sum(axis=1)
                yield pa.RecordBatch.from_arrays([queries.field("_p"), pa.array(above), pa.array(same)], names=["_p", "greater", "ties"])

    return met.mapInArrow(count, "_p bigint, greater bigint, ties bigint")


def product_ranks(positives: DataFrame, known: DataFrame, queries: DataFrame, tails: DataFrame, filtered: bool = True) -> DataFrame:
    """``(head, relation, tail, score, rank)``: ``1 + greater + ties / 2`` among all tails of the relation.

    ``queries`` is ``(head, relation, vector)``, ``tails`` is ``(relation, tail, vector)``, and a score is their product (a relation's
    diagonal belongs into the query vector). With ``filtered`` other known links of the query do not compete. A
    positive whose head or tail has no vector is an error.
    """
    wanted = materialize(positives.select(*TRIPLE).distinct())
    index = materialize(dense_index(tails.select("relation", "tail", "vector"), ["relation"], [F.col("tail")], "_pos"))
    own = index.select("relation", "tail", F.col("_pos").alias("_own"), F.col("vector").alias("_t"))
    scored = wanted.join(queries.select(*_QUERY, "vector"), _QUERY).join(own, ["relation", "tail"]).select(
        *TRIPLE, "vector", "_own", _product("vector", "_t").alias("score"))
    placed = materialize(dense_index(scored, [], [F.col(c) for c in TRIPLE], "_p"))
    missing = wanted.count() - placed.count()
    if missing:
        raise KeyError(f"{missing} positives without a vector at an end")
    mine = _packed(placed, ["relation"], "_p", ["vector", "_own", "score"], BLOCK)
    theirs = _packed(index, ["relation"], "_pos", ["vector"], TAILS).withColumnRenamed("_rows", "_tails")
    blocks = theirs.groupBy("relation").agg(F.max("_block").alias("_last"))
    # every block of positives meets every block of tails of its relation
    pairs = mine.select("relation", F.col("_rows").alias("_mine")).join(blocks, "relation").select(
        "relation", "_mine", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("_block"))
    met = pairs.join(theirs, ["relation", "_block"]).select("_mine", "_tails")
    counts = _counts(met).groupBy("_p").agg(F.sum("greater").alias("greater"), F.sum("ties").alias("ties"))
    ranked = placed.join(counts, "_p")
    if not filtered:
        return ranked.select(*TRIPLE, "score", (1.0 + F.col("greater") + 0.5 * F.col("ties")).alias("rank"))
    # known links of the queries by score; positives stand among them with the weight of their own link
    asked = wanted.select(*_QUERY).distinct()
    links = known.select(*TRIPLE).distinct().join(asked, _QUERY).join(queries.select(*_QUERY, "vector"), _QUERY).join(own, ["relation", "tail"])
    known_scores = links.select(*TRIPLE, _product("vector", "_t").alias("score"))
    is_known = known_scores.select(*TRIPLE, F.lit(1).alias("_known"))
    weights = known_scores.select(*_QUERY, "score", F.lit(1).alias("n")).unionByName(placed.select(*_QUERY, "score", F.lit(0).alias("n")))
    histogram = materialize(weights.groupBy(*_QUERY, "score").agg(F.sum("n").alias("n")).withColumn("_down", -F.col("score")))
    above = with_running_sums(histogram, _QUERY, "_down", ["n"]).select(*_QUERY, "score", F.col("n").alias("_same"), F.col("before_n").alias("_above"))
    full = ranked.join(is_known, list(TRIPLE), "left").join(above, [*_QUERY, "score"])
    ties = F.col("ties") - (F.col("_same") - F.coalesce("_known", F.lit(0)))
    return full.select(*TRIPLE, "score", (1.0 + F.col("greater") - F.col("_above") + 0.5 * ties).alias("rank"))
