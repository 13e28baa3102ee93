"""Mixing sources to target weights with a curriculum, in DataFrame functions only.

Each source has a weight that changes linearly over training time, from ``start`` to
``end``. The integral over time is the source's weight in the mix; its share of the demand
becomes a token target, bounded by a number of passes over the source. The documents
of a source follow each other in the order of a hash; the words before a document,
put into the inverse of the source's cumulative demand, are its training position.

Cases: a null text has size 0; null is a source of its own and comes last; documents of
size 0 are taken 0 times; repeated rows are documents of their own; ties of the hash are
broken by id and size, equal rows are exchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrank.llm.common import WORD_PATTERN, materialize
from graphrank.operators.ordering import dense_index, stable_hash

#: Hash ranges of a source that are ordered independently of each other: 16 ** 3.
_RANGE_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def repeating_schedule(sources: DataFrame, weights: tuple[float, ...], tilt: tuple[float, ...]) -> DataFrame:
    """Add start and end weight to one row per source: by code point, null last, ``weights`` repeat.

    ``tilt`` is the relative change from the mean to the end of training, so the mean is the weight.
    """
    numbered = dense_index(sources, [], [F.col("source").isNull(), F.col("source")], "_number")
    weight, change = (
        F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("_number") % len(values) + 1).cast("int"))
        for values in (weights, tilt)
    )
    return numbered.select("source", "source_size", (weight * (1 - change)).alias("start"), (weight * (1 + change)).alias("end"))


def targets(sources: DataFrame, share: float, passes: float) -> DataFrame:
    """Add ``target``: ``share`` times all sizes, dealt by integrated weight, at most ``passes`` times a source's size.

    What a full source cannot take is dealt to the others by weight until none is above. Each
    round needs three sums over the sources, whatever their number.
    """
    known = materialize(sources.withColumn("weight", (F.col("start") + F.col("end")) / 2))
    limit = F.col("source_size") * F.lit(passes)
    whole = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= limit
        sums = known.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(above, F.lit(1))).alias("full"),
        ).first()
        if sums["full"] == full or not sums["weight"]:
            break
        full, level = sums["full"], (share * whole - passes * sums["size"]) / sums["weight"]
    target = F.least(F.col("weight") * F.lit(level or 0.0), limit)
    return known.withColumn("target", target)


def position_of(words_before: Column) -> Column:
    """Training time in 0..1 at which a source has delivered ``words_before``: the inverse of its cumulative demand.

    With weight a + (b - a) t the demand until t is (a t + (b - a) t^2 / 2) / ((a + b) / 2) of the target.
    """
    demand = words_before / F.col("target") * F.col("weight")
    a, b = F.col("start"), F.col("end")
    return F.when(F.col("target") > 0, 2 * demand / (a + F.sqrt(a * a + 2 * (b - a) * demand)))


def mix(documents: DataFrame, weights: tuple[float, ...], tilt: tuple[float, ...], share: float, passes: float,
        keep: list[str], doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Columns ``keep`` as struct ``row``, and size, source_size, target, taken, position (null if not taken),
    start, end, weight, words_before.

    A source's target is met to the word: whole passes over it, then its first documents
    once more, of which the last is cut. ``documents`` is read twice, for the sizes and for the rows, rather than stored. No group is ordered in one task: a source is cut into
    hash ranges, the sizes of earlier ranges are added as an offset.
    """
    key = stable_hash(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    named = F.col(source).cast("string")
    # a name for every source, null too: the window's partitioning then serves the join, and texts move once
    rows = documents.select(
        F.struct(*keep).alias("row"), named.alias("source"), F.col(doc_id).alias("_id"),
        F.when(named.isNull(), "0").otherwise(F.concat(F.lit("1"), named)).alias("_source"),
        size_of(F.col(text)).alias("size"), key.alias("_key"), F.substring(key, 1, _RANGE_DIGITS).alias("_range"),
    )
    ranges = materialize(rows.groupBy("source", "_source", "_range").agg(F.sum("size").alias("_sum")))
    sources = ranges.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    known = targets(repeating_schedule(sources, weights, tilt), share, passes)
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    # one row per source and range
    per_range = offsets.join(known.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).select(
        "_source", "_range", "_offset", "source_size", "start", "end", "weight", "target")
    within = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(per_range, ["_source", "_range"])
        .withColumn("_before", F.col("_offset") + F.col("_inside"))
    )
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = words - whole * F.col("source_size")
    again = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    taken = (whole * F.col("size") + again).cast("long")
    return placed.select(
        "row", "size", "source_size", "target", taken.alias("taken"),
        F.when(taken > 0, position_of(F.col("_before"))).alias("position"),
        "start", "end", "weight", F.col("_before").alias("words_before"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The rows that training sees, range-sorted by position: a document comes once for each pass that takes words of it."""
    passes = F.ceil(F.col("taken") / F.col("size")).cast("int")
    seen = mixed.where("taken > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    placed = seen.withColumn("position", position_of(F.col("words_before") + F.col("_pass") * F.col("source_size")))
    return placed.orderBy("position").select("row.*")
