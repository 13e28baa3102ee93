"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.plans.lineage import Rounds


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of a link; the label is the smallest node of its component.

    Each round joins the links with the smallest neighbour of each node, so a hub costs as many rows as
    it has links and no list of neighbours is ever built. Rounds grow with the logarithm of the
    longest chain. Lineage is cut by a stored table per round.
    """
    rounds = Rounds()
    stars = rounds.store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours of each node now hang on its smallest neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v")))
        stars = rounds.store(small.where("u != v").distinct())
        sums = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
    # at the end every node hangs on the smallest node of its component
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
