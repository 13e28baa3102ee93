"""Negative links: allowed sources x targets minus forbidden pairs, the first n in the order of a keyed permutation.

All pairs of a relation are numbered, and a Feistel network permutes the numbers: its rounds are keyed by seed, stage and
relation, so the order is a random one, each pair comes once, and nothing is listed but the steps that are taken. Forbidden
pairs are skipped. Steps are taken in chunks of about as many as the share of forbidden pairs lets expect, and
go on only for relations that are still short. A larger sample begins with the smaller one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.operators.ordering import dense_index, hash_number, stable_hash, with_running_sums
from graphrank.plans.lineage import materialize

STRATEGIES = ("random", "degree_matched", "hard")
_CHUNK = 4096
#: Rounds of the permutation; steps of a chunk as a multiple of the expected ones.
ROUNDS, _SLACK = 4, 1.1
#: Thresholds that are counted in one pass.
_FAN = 32
#: Hard pairs that are looked at first, as a multiple of those wanted, the growth of that share, and digits of a digest that bound it.
_HARD_SLACK, _HARD_GROWTH, _HARD_DIGITS = 4.0, 16.0, 12


def halves(pairs: int) -> tuple[int, int]:
    """Sizes of the two halves of the permutation: about equal, their product no less than ``pairs``."""
    left = isqrt(pairs - 1) + 1
    return left, -(-pairs // left)


def _counts(df: DataFrame) -> dict[str, int]:
    """Rows per relation: as many rows as there are relations."""
    return {r["edge_type"]: r["n"] for r in df.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).collect()}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _visited(spark, edge_type: str, size: tuple[int, int], steps: tuple[int, int], seed: int, stage: str) -> DataFrame:
    """The pairs of steps ``[steps[0], steps[1])`` as ``(edge_type, _j, _s, _d)``.

    A step's number is cut in two halves; each round moves one half by a hash of the other, which can be undone, so the
    whole is one-to-one. Numbers from ``pairs`` on, fewer than the root of all, are no pairs.
    """
    placed = _permuted_range(spark, size[0] * size[1], steps, seed, stage, edge_type)
    return placed.select(F.lit(edge_type).alias("edge_type"), "_j", F.expr(f"_place div {size[1]}").alias("_s"), (F.col("_place") % size[1]).alias("_d"))


def _permuted_range(spark, numbers: int, steps: tuple[int, int], *key: str | int) -> DataFrame:
    """(_j, _place) for steps ``[steps[0], steps[1])`` of the permutation of ``numbers`` numbers keyed by ``key``."""
    left, right = halves(numbers)
    j = spark.range(*steps).select(F.col("id").alias("_j")).select("_j", F.expr(f"_j div {right}").alias("_x"), (F.col("_j") % right).alias("_y"))
    for k in range(ROUNDS):
        name, other, width = ("_x", "_y", left) if k % 2 == 0 else ("_y", "_x", right)
        moved = hash_number(stable_hash(*key, k, F.col(other))) % width
        j = j.withColumn(name, (F.col(name) + moved) % width)
    # listed from an array, or the filter would be pushed below the rounds and compute each of them several times over
    return j.select("_j", F.explode_outer(F.array(F.col("_x") * right + F.col("_y"))).alias("_place")).where(F.col("_place") < numbers)


def _ends(index: DataFrame, name: str, position: str) -> DataFrame:
    return index.select("edge_type", F.col("id").alias(name), F.col("idx").alias(position))


def _first(pairs: DataFrame, wanted: dict[str, int], order: str, columns: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """The first pairs per relation in ``order``, as many as wanted. No relation is ordered in one task."""
    placed = dense_index(pairs, ["edge_type"], [F.col(order)], "_first")
    limits = pairs.sparkSession.createDataFrame(list(wanted.items()), "edge_type string, _n bigint")
    # one row per relation
    return placed.join(F.broadcast(limits), "edge_type").where("_first < _n").select("edge_type", *columns)


def sample_negatives(
    sources: DataFrame,
    targets: DataFrame,
    forbidden: DataFrame,
    wanted: dict[str, int],
    seed: int,
    stage: str = "negatives",
    strategy: str = "random",
    degrees: DataFrame | None = None,
    hard_pairs: DataFrame | None = None,
    prefer_hard: bool = False,
) -> DataFrame:
    """Negative pairs ``(edge_type, src, dst)``: ``wanted`` per relation, or all when fewer exist.

    ``sources`` and ``targets`` are ``(edge_type, id)``; ``forbidden`` is
    ``(edge_type, src, dst)``. No result row is forbidden or repeated.

    * ``random``: first of the permutation.
    * ``degree_matched``: pairs of highest degree sum first (``degrees`` is
      ``(edge_type, side, id, degree)``, side ``src`` or ``dst``).
    * ``hard``: the given ``hard_pairs`` when there are enough of them; otherwise
      they compete with all other pairs, or go first with ``prefer_hard``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; one of {STRATEGIES}")
    spark = sources.sparkSession
    wanted = {e: n for e, n in wanted.items() if n > 0}
    empty = spark.createDataFrame([], "edge_type string, src string, dst string")
    if not wanted:
        return empty
    names = list(wanted)
    blocked = forbidden.where(F.col("edge_type").isin(names)).select("edge_type", "src", "dst")
    heads = sources.where(F.col("edge_type").isin(names)).select("edge_type", "id").distinct()
    tails = targets.where(F.col("edge_type").isin(names)).select("edge_type", "id").distinct()

    if strategy == "hard" and hard_pairs is not None:
        eligible, found = _lowest_hard_pairs(hard_pairs, heads, tails, blocked, wanted, seed, stage)
        enough = {e: n for e, n in wanted.items() if found.get(e, 0) >= n}
        short = {e: n for e, n in wanted.items() if e not in enough}
        parts = [_first(eligible.where(F.col("edge_type").isin(list(enough))), enough, "_digest")] if enough else []
        if short and prefer_hard:
            kept = eligible.where(F.col("edge_type").isin(list(short))).select("edge_type", "src", "dst")
            rest = {e: n - found.get(e, 0) for e, n in short.items()}
            parts += [kept, sample_negatives(heads, tails, blocked.unionByName(kept), rest, seed, stage)]
        elif short:
            parts.append(sample_negatives(heads, tails, blocked, short, seed, stage))
        return _union(parts)

    if strategy == "degree_matched" and degrees is not None:
        return _highest_degree_sums(heads, tails, blocked, wanted, seed, stage, degrees)

    head_index = dense_index(heads, ["edge_type"], [F.col("id")])
    tail_index = dense_index(tails, ["edge_type"], [F.col("id")])
    head_counts, tail_counts = _counts(head_index), _counts(tail_index)
    sizes = {e: (head_counts.get(e, 0), tail_counts.get(e, 0)) for e in wanted}
    open_ = {e: n for e, n in wanted.items() if sizes[e][0] * sizes[e][1] > 0}
    if not open_:
        return empty
    head_ends, tail_ends = _ends(head_index, "src", "_s"), _ends(tail_index, "dst", "_d")
    # pairs are compared as positions; only the chosen ones are turned back into ids
    blocked_at = materialize(blocked.join(head_ends, ["edge_type", "src"]).join(tail_ends, ["edge_type", "dst"]).select(
        "edge_type", "_s", "_d"
    ).distinct())
    chosen = _first(_walked(blocked_at, sizes, open_, seed, stage), open_, "_j", ("_s", "_d"))
    return chosen.join(head_ends, ["edge_type", "_s"]).join(tail_ends, ["edge_type", "_d"]).select("edge_type", "src", "dst")


def _lowest_hard_pairs(
    hard_pairs: DataFrame, heads: DataFrame, tails: DataFrame, blocked: DataFrame, wanted: dict[str, int], seed: int, stage: str
) -> tuple[DataFrame, dict[str, int]]:
    """Eligible hard pairs ``(edge_type, src, dst, _digest)`` and their number per relation: all of them where fewer than
    wanted exist, else at least the ``wanted`` ones of lowest digest.

    The given pairs may be many times the links, as two-step ways are, so they are neither stored nor shuffled whole: only those
    below a bound on the digest go on. The bound of a relation starts at what its rows let expect and rises until there are enough.
    """
    given = hard_pairs.select("edge_type", "src", "dst")
    rows = _counts(given.where(F.col("edge_type").isin(list(wanted))))
    digest = stable_hash(seed, stage, F.col("edge_type"), F.col("src"), F.col("dst"))
    share = {e: min(1.0, _HARD_SLACK * n / rows[e]) for e, n in wanted.items() if rows.get(e, 0)}
    kept, found = [], {}
    while share:
        below = F.lit(False)
        for e, part in share.items():
            bound = int(part * 16**_HARD_DIGITS)
            below = below | ((F.col("edge_type") == e) & (F.lit(part >= 1.0) | (hash_number(F.col("_digest"), 1, _HARD_DIGITS) < bound)))
        # taken from an array: else the filter is pushed below and computes the digest a second time
        low = given.select("*", F.explode(F.array(digest)).alias("_digest")).where(below)
        part = materialize(
            low.distinct()
            .join(heads.withColumnRenamed("id", "src"), ["edge_type", "src"], "left_semi")
            .join(tails.withColumnRenamed("id", "dst"), ["edge_type", "dst"], "left_semi")
            .join(blocked, ["edge_type", "src", "dst"], "left_anti")
        )
        counts = _counts(part)
        done = [e for e in share if share[e] >= 1.0 or counts.get(e, 0) >= wanted[e]]
        if done:
            kept.append(part.where(F.col("edge_type").isin(done)))
            found |= {e: counts.get(e, 0) for e in done}
        share = {e: min(1.0, _HARD_GROWTH * p) for e, p in share.items() if e not in done}
    if not kept:
        return given.withColumn("_digest", digest).limit(0), found
    return _union(kept), found


def _walked(blocked_at: DataFrame, sizes: dict[str, tuple[int, int]], wanted: dict[str, int], seed: int, stage: str) -> DataFrame:
    """Eligible pairs ``(edge_type, _j, _s, _d)`` of the steps that are needed for ``wanted`` pairs, or of all steps."""
    spark = blocked_at.sparkSession
    taken = _counts(blocked_at)
    ends = {e: left * right for e, (left, right) in ((e, halves(a * b)) for e, (a, b) in sizes.items() if e in wanted)}
    free = {e: sizes[e][0] * sizes[e][1] - taken.get(e, 0) for e in wanted}
    need = {e: min(n, free[e]) for e, n in wanted.items()}
    at, parts = dict.fromkeys(wanted, 0), []
    while short := {e: n for e, n in need.items() if n > 0 and at[e] < ends[e]}:
        to = {e: min(ends[e], at[e] + ceil(_SLACK * n * ends[e] / free[e]) + 64) for e, n in short.items()}
        steps = _union([_visited(spark, e, sizes[e], (at[e], to[e]), seed, stage) for e in short])
        got = materialize(steps.join(blocked_at, ["edge_type", "_s", "_d"], "left_anti").select("edge_type", "_j", "_s", "_d"))
        parts.append(got)
        for e, n in _counts(got).items():
            need[e] -= n
        at |= to
    return _union(parts) if parts else blocked_at.select("edge_type", F.lit(0).cast("bigint").alias("_j"), "_s", "_d").limit(0)


def _largest(low: int, high: int, counts: Callable[[list[int]], list[int]], n: int) -> int:
    """The largest number in [low, high] that at least ``n`` are counted from; ``low`` must do. ``_FAN`` numbers are tried per pass."""
    while low < high:
        tried = sorted({low + -(-(high - low) * k // _FAN) for k in range(1, _FAN + 1)})
        enough = [t for t, found in zip(tried, counts(tried), strict=True) if found >= n]
        low, high = max(enough, default=low), min((t for t in tried if t not in enough), default=high + 1) - 1
    return low


def _histogram(ranked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(degrees, ascending; nodes of that degree or more). L links have at most sqrt(2 L) distinct degrees."""
    found = sorted((r["degree"], r["n"]) for r in ranked.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).collect())
    degree = np.array([d for d, _ in found], dtype=np.int64)
    return degree, np.cumsum(np.array([n for _, n in found], dtype=np.int64)[::-1])[::-1]


def _region(row: DataFrame, col: DataFrame, blocked_at: DataFrame, n: int) -> DataFrame:
    """Rows with ``_reach``: their pairs with the first ``_reach`` columns hold the first ``n`` eligible pairs.

    Pairs are counted, not listed: the least degree sum from the two histograms, then, among
    the pairs of just that sum, the largest product of ranks from one pass over the rows a step. ``blocked_at`` is
    (_sum, _area) of the forbidden pairs.
    """
    (row_degree, row_many), (col_degree, col_many) = _histogram(row), _histogram(col)
    row_count = row_many - np.append(row_many[1:], 0)

    def columns_from(degree: np.ndarray) -> np.ndarray:
        """Number of columns of at least these degrees."""
        return np.append(col_many, 0)[np.searchsorted(col_degree, degree)]

    def blocked(condition: Callable[[int], Column], tried: list[int]) -> list[int]:
        return list(blocked_at.agg(*[F.count_if(condition(t)) for t in tried]).first())

    def eligible_from(sums: list[int]) -> list[int]:
        all_ = [int((row_count * columns_from(t - row_degree)).sum()) for t in sums]
        return [a - b for a, b in zip(all_, blocked(lambda t: F.col("_sum") >= t, sums), strict=True)]

    if eligible_from([0])[0] <= n:
        return row.withColumn("_reach", F.lit(int(col_many[0])).cast("bigint"))
    least = _largest(0, int(row_degree[-1] + col_degree[-1]), eligible_from, n)
    rest = n - eligible_from([least + 1])[0]
    spans = row.sparkSession.createDataFrame(
        list(zip(row_degree.tolist(), columns_from(least + 1 - row_degree).tolist(), columns_from(least - row_degree).tolist(), strict=True)),
        "degree bigint, _above bigint, _with bigint")
    placed = materialize(row.join(spans, "degree"))

    def reach(area: int) -> Column:
        return F.least(F.col("_with"), F.expr(f"{area}L div (idx + 1)"))

    def missing(negated: list[int]) -> list[int]:
        """For areas -t: eligible pairs of the least sum up to that area."""
        listed = placed.agg(*[F.sum(F.greatest(reach(-t) - F.col("_above"), F.lit(0))) for t in negated]).first()
        return [a - b for a, b in zip(listed, blocked(lambda t: (F.col("_sum") == least) & (F.col("_area") <= -t), negated), strict=True)]

    area = -_largest(-int(row_many[0] * col_many[0]), -1, missing, rest)
    return placed.select(*row.columns, F.greatest("_above", reach(area)).alias("_reach"))


def _highest_degree_sums(
    heads: DataFrame, tails: DataFrame, blocked: DataFrame, wanted: dict[str, int], seed: int, stage: str,
    degrees: DataFrame,
) -> DataFrame:
    """First n eligible pairs by degree sum, listing little more than those.

    Both sides are ranked by degree, equal degrees in hash order. Equal sums are ordered by (i+1)(j+1) of the
    ranks, then by hash. How far each row reaches is found by counting (see ``_region``), so
    what is listed are the n pairs, forbidden pairs among them, and ties of the last product.
    """
    def ranked(nodes: DataFrame, side: str) -> DataFrame:
        known = degrees.where(F.col("side") == side).select("edge_type", "id", "degree")
        scored = nodes.join(known, ["edge_type", "id"], "left").select(
            "edge_type", "id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")
        )
        tie = stable_hash(seed, side, F.col("edge_type"), F.col("id"))
        return materialize(dense_index(scored.withColumn("_tie", tie), ["edge_type"], [F.desc("degree"), F.col("_tie")]).drop("_tie"))

    row, col = ranked(heads, "src"), ranked(tails, "dst")
    sides = [d.select("edge_type", F.col("id").alias(c), F.col("degree").alias(f"_{c}_degree"), F.col("idx").alias(f"_{c}_idx")) for d, c in ((row, "src"), (col, "dst"))]
    blocked_at = materialize(blocked.distinct().join(sides[0], ["edge_type", "src"]).join(sides[1], ["edge_type", "dst"]).select(
        "edge_type", (F.col("_src_degree") + F.col("_dst_degree")).alias("_sum"), ((F.col("_src_idx") + 1) * (F.col("_dst_idx") + 1)).alias("_area")))
    present = set(_counts(row)) & set(_counts(col))
    parts = []
    for e, n in wanted.items():
        if e in present:
            of = F.col("edge_type") == e
            parts.append(_region(row.where(of), col.where(of), blocked_at.where(of), n))
    if not parts:
        return row.select("edge_type", F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    # the first rows reach far: cut them into chunks and spread those before listing the pairs
    chunks = (
        _union(parts).where("_reach > 0")
        .withColumn("_from", F.explode(F.expr(f"sequence(0L, _reach - 1, {_CHUNK}L)")))
        .repartition("edge_type", "idx", "_from")
    )
    pairs = (
        chunks.withColumn("_d", F.explode(F.expr(f"sequence(_from, least(_from + {_CHUNK}L, _reach) - 1)")))
        .select("edge_type", F.col("id").alias("src"), F.col("degree").alias("_ds"), F.col("idx").alias("_s"), "_d")
        .join(col.select("edge_type", F.col("id").alias("dst"), F.col("degree").alias("_dd"), F.col("idx").alias("_d")),
              ["edge_type", "_d"])
        .join(blocked, ["edge_type", "src", "dst"], "left_anti")
        .select(
            "edge_type", "src", "dst",
            (F.col("_ds") + F.col("_dd")).alias("_sum"),
            ((F.col("_s") + 1) * (F.col("_d") + 1)).alias("_area"),
            stable_hash(seed, stage, F.col("edge_type"), F.col("src"), F.col("dst")).alias("_digest"),
        )
    )
    placed = dense_index(pairs, ["edge_type"], [F.desc("_sum"), F.col("_area"), F.col("_digest")], "_place")
    want = F.lit(None).cast("bigint")
    for e, n in wanted.items():
        want = F.when(F.col("edge_type") == e, F.lit(n).cast("bigint")).otherwise(want)
    return placed.where(F.col("_place") < want).select("edge_type", "src", "dst")


def sample_hard_pairs(
    links: DataFrame, near: DataFrame, forbidden: DataFrame, wanted: int, seed: int, stage: str = "hard",
    targets: DataFrame | None = None,
) -> DataFrame:
    """``wanted`` pairs ``(src, dst)`` two steps apart: a link ``src - middle``, then ``middle - dst`` of ``near`` (a, b).

    Ways are numbered by middle node, link and neighbour, and taken in the order of a keyed permutation, so a pair comes with
    the weight of its ways and the list of all ways is never made: a way's number tells the middle node, of which the
    link and the neighbour are looked up by position. A hub's ways are spread like any others. Forbidden
    pairs, pairs of a node with itself and ends not in ``targets`` (id) are skipped; the way on which a pair comes first counts.
    """
    spark = links.sparkSession
    open_near = near.select(F.col("a").alias("mid"), F.col("b").alias("dst")).distinct()
    if targets is not None:
        open_near = open_near.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    heads = materialize(dense_index(links.select(F.col("dst").alias("mid"), "src").distinct(), ["mid"], [F.col("src")], "_s"))
    tails = materialize(dense_index(open_near, ["mid"], [F.col("dst")], "_d"))
    counts = [d.groupBy("mid").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias(c)) for d, c in ((heads, "_heads"), (tails, "_tails"))]
    middles = materialize(dense_index(counts[0].join(counts[1], "mid"), [], [F.col("mid")], "_m"))
    empty = links.select("src", F.col("src").alias("dst")).limit(0)
    if wanted <= 0 or middles.isEmpty():
        return empty
    ways = materialize(with_running_sums(middles.withColumn("_ways", F.col("_heads") * F.col("_tails")), [], "_m", ["_ways"]).select(
        "mid", F.col("_tails").cast("bigint"), F.col("before__ways").cast("bigint").alias("_first"), F.col("_ways").cast("bigint")))
    total = ways.agg(F.sum("_ways")).first()[0]
    # ranges of numbers, so that a number finds its middle node by an equal join: about four ranges for each pair wanted
    width = max(1, total // (4 * wanted))
    ranges = materialize(ways.select("*", F.explode(F.expr(f"sequence(_first div {width}, (_first + _ways - 1) div {width})")).alias("_range")))
    end, at, found = halves(total)[0] * halves(total)[1], 0, None
    blocked = forbidden.select("src", "dst")
    while at < end:
        to = min(end, at + ceil(_SLACK * wanted * (2 if found is not None else 1)) + 64)
        numbers = _permuted_range(spark, total, (at, to), seed, stage).withColumn("_range", F.expr(f"_place div {width}"))
        own = numbers.join(ranges, "_range").where("_place >= _first AND _place < _first + _ways").select(
            "_j", "mid", F.expr("(_place - _first) div _tails").alias("_s"), F.expr("(_place - _first) % _tails").alias("_d"))
        pairs = own.join(heads, ["mid", "_s"]).join(tails, ["mid", "_d"]).where("src <> dst").join(blocked, ["src", "dst"], "left_anti")
        both = pairs.select("src", "dst", "_j") if found is None else found.unionByName(pairs.select("src", "dst", "_j"))
        found = materialize(both.groupBy("src", "dst").agg(F.min("_j").alias("_j")))
        at = to
        if found.count() >= wanted:
            break
    placed = dense_index(found, [], [F.col("_j")], "_place")
    return placed.where(F.col("_place") < wanted).select("src", "dst")
