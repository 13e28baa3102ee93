"""Exact link-prediction metrics over scored candidates.

All metrics are read off histograms of distinct scores. The histograms are
built with map-side combines and their running sums are split along the score
axis, so neither a query with a third of all candidates nor a score shared by
a third of all rows ends up in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrank.operators.ordering import (
    dense_index,
    hash_number,
    stable_hash,
    top_per_key,
    with_running_sums,
)
from graphrank.plans.lineage import materialize, shuffle_partitions

DEFAULT_SEEDS = (13, 17, 19, 23, 29)
TRIPLE = ("head", "relation", "tail")
_QUERY = ["head", "relation"]
_SHIFT = 32
_CHUNK = 4096
#: Known tails and positives of a query that its row may hold; walks a task; distinct scores of a query that one window may order.
HELD, _WALKS, _WINDOW = 4096, 1000, 1 << 20

Scorer = Callable[[DataFrame], DataFrame]


# --------------------------------------------------------------------------- classification


def comparable(score: Column) -> Column:
    """A missing or NaN score is below every other score."""
    value = score.cast("double")
    return F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(value)


def _score_histogram(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*keys, comparable(F.col("score")).alias("score")).agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("label")).cast("bigint")).alias("neg"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Ascending ranks, ties at their average, as ``average_rank``."""
    hist = materialize(df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n")))
    ranked = with_running_sums(hist, keys, score, ["n"]).select(
        *keys, score, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("average_rank")
    )
    return df.join(ranked, [*keys, score])


def auroc(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per key; NaN when a class is empty. Ties count half."""
    return _auroc(materialize(_score_histogram(labelled, keys)), keys)


def _auroc(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    summed = with_running_sums(hist, keys, "score", ["neg"])
    below = F.col("before_neg").cast("double") + F.col("neg") / 2.0
    totals = summed.groupBy(*keys).agg(
        F.sum(F.col("pos") * below).alias("_w"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
    )
    pairs = F.col("_p") * F.col("_n")
    return totals.select(
        *keys, F.when(pairs > 0, F.col("_w") / F.nullif(pairs, F.lit(0.0))).otherwise(float("nan")).alias("auroc")
    )


def _harmonic(n: Column) -> Column:
    """Harmonic number, less Euler's constant (it cancels): exact to double precision from n = 32 on."""
    return F.log(n) + 1.0 / (2.0 * n) - 1.0 / (12.0 * n * n) + 1.0 / (120.0 * n * n * n * n) - 1.0 / (252.0 * F.pow(n, 6))


def _precision_gain(p: Column, above: Column, above_neg: Column) -> Column:
    """Summed precisions of a tie group with ``p`` positives after ``above`` positives and ``above_neg`` negatives."""
    f, c = above_neg.cast("double"), (above + above_neg).cast("double")
    moved = sum((1.0 / (c + i) - 1.0 / (c + p + i) for i in range(1, _SHIFT + 1)), F.lit(0.0))
    difference = _harmonic(c + p + _SHIFT) - _harmonic(c + _SHIFT) + moved
    return F.when(f == 0.0, p.cast("double")).otherwise(p - f * difference)


def _areas(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``auroc`` and ``auprc`` per key with the counts, from one pass over the running sums: what is above a score is the rest of what is below."""
    keys = list(keys)
    counts = hist.groupBy(*keys).agg(F.sum("pos").alias("num_positives"), F.sum("neg").alias("num_negatives"))
    counts = materialize(reduce(DataFrame.where, [F.col(k).isNotNull() for k in keys], counts))
    hits = with_running_sums(hist, keys, "score", ["pos", "neg"]).where("pos > 0").join(counts, keys)
    below = F.col("before_neg").cast("double") + F.col("neg") / 2.0
    gain = _precision_gain(F.col("pos"), F.col("num_positives") - F.col("before_pos") - F.col("pos"),
                           F.col("num_negatives") - F.col("before_neg") - F.col("neg"))
    sums = hits.groupBy(*keys).agg(F.sum(F.col("pos") * below).alias("_w"), F.sum(gain).alias("_g"))
    pairs = F.col("num_positives").cast("double") * F.col("num_negatives").cast("double")
    auroc = F.when(pairs > 0, F.col("_w") / F.nullif(pairs, F.lit(0.0)))
    nan = F.lit(float("nan"))
    return counts.join(sums, keys, "left").select(
        *keys, "num_positives", "num_negatives", F.coalesce(auroc, nan).alias("auroc"), F.coalesce(F.col("_g") / F.col("num_positives"), nan).alias("auprc"))


def auprc(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision per key; positives come first among equal scores. NaN without positives.

    A tie group with p positives after c rows (f of them negative) adds
    sum over i of (c - f + i) / (c + i) = p - f * (H(c+p) - H(c)). The harmonic
    difference is that of the arguments moved up by a fixed number of terms, taken
    from the asymptotic series, and those terms: one formula for tie groups of any size.
    """
    return _auprc(materialize(_score_histogram(labelled, keys)), keys)


def _auprc(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    summed = with_running_sums(hist.withColumn("_down", -F.col("score")), keys, "_down", ["pos", "neg"]).where("pos > 0")
    gain = _precision_gain(F.col("pos"), F.col("before_pos"), F.col("before_neg"))
    scored = summed.groupBy(*keys).agg((F.sum(gain) / F.sum("pos")).alias("auprc"))
    if not keys:
        return scored.select(F.coalesce("auprc", F.lit(float("nan"))).alias("auprc"))
    every = hist.select(*keys).distinct()
    return every.join(scored, list(keys), "left").select(
        *keys, F.coalesce("auprc", F.lit(float("nan"))).alias("auprc")
    )


# --------------------------------------------------------------------------- ranking


def _competitor_histogram(candidates: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates of each query by score: all of them, and those that are not known links."""
    flagged = _with_known(candidates, known)
    return flagged.groupBy(*keys, *_QUERY, "score").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("open")
    )


def _with_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    links = known.select(*TRIPLE).distinct().withColumn("_known", F.lit(True))
    return candidates.join(links, list(TRIPLE), "left").withColumn(
        "known", F.coalesce("_known", F.lit(False))
    ).drop("_known")


def filtered_ranks(
    scores: DataFrame, positives: DataFrame, known: DataFrame, keys: Sequence[str] = (), filtered: bool = True
) -> DataFrame:
    """Rank of each positive among its query's candidates: ``1 + greater + ties / 2``.

    ``scores`` is ``(keys, head, relation, tail, score)`` with one row per
    candidate. With ``filtered`` other known links of the query do not compete.
    A positive without a score is an error.
    """
    triple = [*keys, *TRIPLE]
    scores = scores.withColumn("score", comparable(F.col("score")))
    missing = positives.join(scores, triple, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"no score for positive {tuple(missing[0])}")
    hist = materialize(
        _competitor_histogram(scores, known, keys).withColumn("_down", -F.col("score"))
    )
    summed = with_running_sums(hist, [*keys, *_QUERY], "_down", ["n", "open"])
    own = _with_known(positives.select(*triple).distinct().join(scores, triple), known)
    placed = own.join(summed.drop("_down"), [*keys, *_QUERY, "score"])
    if filtered:
        self_comp = F.when(F.col("known"), 0).otherwise(1)
        rank = 1.0 + F.col("before_open") + 0.5 * (F.col("open") - self_comp)
    else:
        rank = 1.0 + F.col("before_n") + 0.5 * (F.col("n") - 1)
    return placed.select(*triple, "score", rank.alias("rank"))


def ranking_metrics(ranks: DataFrame, keys: Sequence[str] = (), ks: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """``hits_at_k`` and ``mrr`` per key from a ``rank`` column."""
    hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks]
    return ranks.groupBy(*keys).agg(*hits, F.avg(1.0 / F.col("rank")).alias("mrr"))


# --------------------------------------------------------------------------- candidates


def next_prime(n: int) -> int:
    """Smallest prime that is at least ``n``."""
    candidate = max(n, 2)
    while any(candidate % d == 0 for d in range(2, int(candidate**0.5) + 1)):
        candidate += 1
    return candidate


def _parts(positives: DataFrame, seeds: Sequence[int]) -> int:
    """Tasks that the candidates are spread over: each has those of some thousand walks."""
    walks = positives.select(*TRIPLE).distinct().count() * len(seeds)
    return max(shuffle_partitions(positives.sparkSession), -(-walks // _WALKS))


def sample_tails(
    positives: DataFrame, known: DataFrame, tails: DataFrame, per_positive: int = 1000, seeds: Sequence[int] = (13,),
    held: int = HELD,
) -> DataFrame:
    """Unknown tails per positive and seed: ``per_positive`` of them, or all when fewer exist.

    ``tails`` is ``(relation, tail)``, all tails a relation may have. Every
    positive walks the indexed tails in its own order ``(a*j + b) mod p`` (p the
    smallest prime not below the tail count, a and b from its hash), skipping
    known ones, so neither heads x tails nor a sort of all tails is needed.
    A query of up to ``held`` known tails and positives has the known ones in its row, and a walk is done in that row:
    no step is shuffled or stored, and all tails of a query stay in the task of its ``(head, relation)``.
    Walks of larger queries are rows, which meet the known tails by a join.
    Returns ``(seed, head, relation, true_tail, tail)``.
    """
    index = materialize(dense_index(tails.select("relation", "tail").distinct(), ["relation"], [F.col("tail")], "_pos"))
    sizes = {r["relation"]: r["n"] for r in index.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = positives.sparkSession
    bases = dict(zip(sizes, accumulate(sizes.values(), initial=0)))
    params = spark.createDataFrame(
        [(rel, n, next_prime(n), bases[rel]) for rel, n in sizes.items()], "relation string, _size bigint, _prime bigint, _base bigint"
    )
    wanted = positives.select(*TRIPLE).distinct()
    # the walk is done on numbers: a query and a tail are one long each
    queries = materialize(wanted.groupBy(*_QUERY).agg(F.count(F.lit(1)).alias("_many")).withColumn("_q", F.monotonically_increasing_id()))
    blocked = materialize(
        known.select(*TRIPLE).distinct().join(queries, _QUERY).join(index, ["relation", "tail"]).select("_q", "_pos")
    )
    degree = blocked.groupBy("_q").agg(F.count(F.lit(1)).alias("_deg"))
    own = index.select("relation", F.col("tail"), F.col("_pos").alias("_true"))
    is_known = blocked.select("_q", F.col("_pos").alias("_true"), F.lit(1).alias("_hit"))
    # a true tail that is no known link, but a tail of the relation, is not open to itself
    self_open = F.when(F.col("_true").isNotNull() & F.col("_hit").isNull(), 1).otherwise(0)
    walks = materialize(
        wanted.join(queries, _QUERY)
        .join(own, ["relation", "tail"], "left")
        .join(degree, "_q", "left")
        .join(is_known, ["_q", "_true"], "left")
        .join(F.broadcast(params), "relation")
        .select(
            "head", "relation", F.col("tail").alias("true_tail"), "_q", "_true", "_size", "_prime", "_base",
            F.greatest("_many", F.coalesce("_deg", F.lit(0))).alias("_load"),
            F.greatest(F.col("_size") - F.coalesce("_deg", F.lit(0)) - self_open, F.lit(0)).alias("_open"),
        )
        .withColumn("_want", F.least(F.lit(per_positive).cast("bigint"), F.col("_open")))
        .where("_want > 0")
    )

    def seeded(rows: DataFrame) -> DataFrame:
        """A walk for every seed. The parameters of all seeds are made in one row and listed then, so none is computed again for each step."""
        prime = F.col("_prime")

        def parameters(seed: int) -> Column:
            digest = stable_hash(seed, F.col("head"), F.col("relation"), F.col("true_tail"))
            a = 1 + hash_number(digest, 1, 15) % F.greatest(prime - 1, F.lit(1))
            return F.struct(F.lit(seed).alias("seed"), a.alias("_a"), (hash_number(digest, 16, 15) % prime).alias("_b"))

        listed = rows.select("*", F.explode(F.array(*[parameters(s) for s in seeds])).alias("_s"))
        return listed.select(*rows.columns, "_s.seed", "_s._a", "_s._b")

    who = ["seed", "head", "relation", "true_tail"]
    small = F.col("_load") <= held
    near_known = blocked.join(degree.where(F.col("_deg") <= held), "_q").groupBy("_q").agg(F.collect_list("_pos").alias("_known"))
    near = seeded(
        walks.where(small).join(near_known, "_q", "left")
        .withColumn("_known", F.coalesce("_known", F.array().cast("array<bigint>")))
        .repartition(_parts(positives, seeds), *_QUERY)
    )
    # the steps at which a walk meets a tail it may not take, or a number beyond the tails, follow from the inverse of a:
    # so the length of the walk is known before it is listed
    inverse = F.expr("aggregate(sequence(31, 0, -1), 1L, (x, k) -> (x * x % _prime) * if((shiftright(_prime - 2, k) & 1) = 1, _a, 1L) % _prime)")
    beyond = F.when(F.col("_prime") > F.col("_size"), F.sequence("_size", F.col("_prime") - 1)).otherwise(F.array().cast("array<bigint>"))
    closed = F.array_distinct(F.concat("_known", F.array_compact(F.array("_true")), beyond))
    number = ["_a", "_b", "_prime", "_base", "_want"]
    walk = near.select(*who, *number, closed.alias("_closed"), F.explode(F.array(inverse)).alias("_inverse"))
    met = F.array_sort(F.transform("_closed", lambda at: (at - F.col("_b") + F.col("_prime")) % F.col("_prime") * F.col("_inverse") % F.col("_prime")))
    skipped = F.filter(met, lambda step, i: step - i < F.col("_want")).alias("_skip")
    steps = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("_want") + F.size("_skip") - 1), "_skip")
    listed = walk.select(*who, *number, skipped).select(*who, *number, F.explode(steps).alias("_j"))
    # tails of all relations by one number: the join reads it from an array while the tails are few enough to be broadcast
    placed = listed.select(*who, ((F.col("_a") * F.col("_j") + F.col("_b")) % F.col("_prime") + F.col("_base")).alias("_row"))
    rows = materialize(index.join(F.broadcast(params.select("relation", "_base")), "relation").select("tail", (F.col("_base") + F.col("_pos")).alias("_row")))
    out = placed.join(rows, "_row").select(*who, "tail")
    if not walks.where(~small).isEmpty():
        # expected length of the walk, with some slack; the whole cycle is the upper end
        expected = F.ceil(1.25 * F.col("_want") * F.col("_prime") / F.greatest(F.col("_open"), F.lit(1))) + 16
        large = materialize(seeded(walks.where(~small)).withColumn("_to", F.least(expected, F.col("_prime"))).withColumn("_w", F.monotonically_increasing_id()))
        found = _walked_rows(large, blocked).join(large.select("_w", *who), "_w").join(index, ["relation", "_pos"])
        out = out.unionByName(found.select(*who, "tail"))
    return out


def _walked_rows(walkers: DataFrame, blocked: DataFrame) -> DataFrame:
    """The first ``_want`` tails ``(_w, _pos)`` of every walk that are not blocked, a row a step; only short walks are lengthened."""
    numbers = ["_w", "_q", "_true", "_size", "_prime", "_a", "_b", "_want"]
    pending = walkers.select(*numbers, F.lit(0).cast("bigint").alias("_from"), "_to")
    parts = []
    while True:
        # a walk is listed in chunks, however many steps it has
        chunk = F.explode(F.sequence("_from", F.col("_to") - 1, F.lit(_CHUNK).cast("bigint"))).alias("_chunk")
        steps = pending.select("*", chunk).withColumn(
            "_j", F.explode(F.sequence("_chunk", F.least(F.col("_chunk") + _CHUNK, F.col("_to")) - 1)))
        at = ((F.col("_a") * F.col("_j") + F.col("_b")) % F.col("_prime")).alias("_pos")
        visited = steps.select("_w", "_q", "_want", "_j", at, "_size", "_true").where(
            (F.col("_pos") < F.col("_size")) & (F.col("_true").isNull() | (F.col("_pos") != F.col("_true")))
        )
        eligible = visited.select("_w", "_q", "_want", "_j", "_pos").join(blocked, ["_q", "_pos"], "left_anti")
        # a walker owns at most its walk length of rows
        place = F.row_number().over(Window.partitionBy("_w").orderBy("_j"))
        got = materialize(eligible.withColumn("_rank", place).where("_rank <= _want").select("_w", "_pos"))
        parts.append(got)
        full = got.groupBy("_w").agg(F.count(F.lit(1)).alias("_got"))
        # who still lacks tails walks on from where it stopped
        short = materialize(
            pending.join(full, "_w", "left").withColumn("_want", F.col("_want") - F.coalesce("_got", F.lit(0))).where("_want > 0").drop("_got")
        )
        if short.isEmpty():
            break
        pending = short.withColumn("_from", F.col("_to")).withColumn("_to", F.least(F.col("_to") * 2, F.col("_prime")))
    return reduce(DataFrame.unionByName, parts)


def candidate_triples(positives: DataFrame, sampled: DataFrame, seeds: Sequence[int] = (13,), known: DataFrame | None = None) -> DataFrame:
    """Candidates per seed: sampled unknown tails and all positives, merged per query.

    ``positives`` is ``(head, relation, tail)``. Returns ``(seed, head,
    relation, tail, label)`` without repeats; label 1 marks positives. With the ``known`` links that the tails were sampled
    without, ``known`` is added. Positives are laid out like the sampled tails, so that merging moves no sampled row.
    """
    own = positives.select(*TRIPLE).distinct()
    flags = [F.lit(1).alias("label")]
    if known is not None:
        own, flags = _with_known(own, known), [*flags, F.col("known")]
    none = [F.lit(0).alias("label"), *([F.lit(False).alias("known")] if known is not None else [])]
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    laid = own.repartition(_parts(positives, seeds), *_QUERY).select(seed, *TRIPLE, *flags)
    merged = sampled.select("seed", *TRIPLE, *none).unionByName(laid).groupBy("seed", *TRIPLE)
    return merged.agg(F.max("label").alias("label"), *([F.max("known").alias("known")] if known is not None else []))


def evaluate_scores(
    scored: DataFrame, known: DataFrame, keys: Sequence[str] = ("seed",), ks: Sequence[int] = (1, 3, 10)
) -> DataFrame:
    """One row per key: AUROC, AUPRC, raw and filtered Hits@k and MRR, counts; NaN where a key has no positive.

    Without ``keys`` all rows are one evaluation. A missing or NaN score is below every other.

    ``scored`` is ``(keys, head, relation, tail, label, score)`` as made by
    :func:`candidate_triples` and a scorer. Where it says by ``known`` which rows are known links, they are not looked up again.
    """
    if not keys:
        return evaluate_scores(scored.withColumn("_all", F.lit(0)), known, ["_all"], ks).drop("_all")
    keys = list(keys)
    query = [*keys, *_QUERY]
    rows = scored.withColumn("score", comparable(F.col("score")))
    flagged = rows if "known" in rows.columns else _with_known(rows.select(*query, "tail", "label", "score"), known)
    # the candidates are read once: every metric follows from the histogram of each query
    hist = materialize(
        flagged.groupBy(*query, "score")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("known")).alias("open"),
            F.count_if((F.col("label") == 1) & F.col("known")).alias("pos_known"),
            F.count_if((F.col("label") == 1) & ~F.col("known")).alias("pos_open"),
            F.sum(F.col("label").cast("bigint")).alias("pos"),
            F.sum((1 - F.col("label")).cast("bigint")).alias("neg"),
        )
        .withColumn("_down", -F.col("score"))
    )
    by_score = materialize(hist.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    out = _areas(by_score, keys)
    # positives need not be looked up again: their ranks follow from the histogram of their score
    longest = hist.groupBy(*query).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if longest <= _WINDOW:
        above = Window.partitionBy(*query).orderBy("_down").rowsBetween(Window.unboundedPreceding, -1)
        summed = hist.select("*", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"before_{v}") for v in ("n", "open")])
    else:
        summed = with_running_sums(hist, query, "_down", ["n", "open"])
    placed = summed.where("pos_known + pos_open > 0")
    raw = 1.0 + F.col("before_n") + 0.5 * (F.col("n") - 1)
    among_open = 1.0 + F.col("before_open") + 0.5 * F.col("open")
    cases = F.array(
        F.struct(F.col("pos_known").alias("w"), raw.alias("raw"), among_open.alias("filtered")),
        F.struct(F.col("pos_open").alias("w"), raw.alias("raw"), (among_open - 0.5).alias("filtered")),
    )
    weighted = placed.select(*keys, F.explode(cases).alias("_c")).select(*keys, "_c.*").where("w > 0")
    metrics = [
        (F.sum(F.col("w") * value) / F.sum("w")).alias(f"{name}_{label}")
        for name in ("raw", "filtered")
        for label, value in [
            *[(f"hits_at_{k}", (F.col(name) <= k).cast("double")) for k in ks], ("mrr", 1.0 / F.col(name))
        ]
    ]
    ranked = out.join(weighted.groupBy(*keys).agg(*metrics), keys, "left")
    names = [c for c in ranked.columns if c not in out.columns]
    return ranked.select(*out.columns, *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in names])


def evaluate_model(
    scorer: Scorer, positives: DataFrame, known: DataFrame, tails: DataFrame, per_positive: int = 1000,
    seeds: Sequence[int] = (13,),
) -> DataFrame:
    """Sample candidates for all seeds at once, score them in one pass and evaluate per seed.

    A scorer maps ``(head, relation, tail)`` rows to the same rows with ``score``.
    """
    sampled = sample_tails(positives, known, tails, per_positive, seeds)
    candidates = candidate_triples(positives, sampled, seeds, known)
    return evaluate_scores(scorer(candidates), known, ["seed"])


def tails_of_relations(nodes: DataFrame, relation_types: dict[str, str]) -> DataFrame:
    """All nodes of each relation's target type as ``(relation, tail)``."""
    pairs = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(t).alias("_type")) for r, t in relation_types.items()])
    wanted = nodes.select("node_id", "node_type", F.explode(pairs).alias("_p"))
    return wanted.where(F.col("node_type") == F.col("_p._type")).select("_p.relation", F.col("node_id").alias("tail"))


def evaluate_split(
    scorer: Scorer, links: DataFrame, known: DataFrame, tails: DataFrame, split: str = "test",
    per_positive: int = 1000, seeds: Sequence[int] = (13,),
) -> DataFrame:
    """Metrics of one split: its labelled positives against all known links of the whole graph."""
    rows = links.where((F.col("split") == split) & (F.col("role") == "supervision") & (F.col("label") == 1))
    positives = rows.select(F.col("src").alias("head"), F.col("edge_type").alias("relation"), F.col("dst").alias("tail"))
    return evaluate_model(scorer, positives, known, tails, per_positive, seeds)


# --------------------------------------------------------------------------- seeds and significance


def require_seeds(metrics: DataFrame, by: str = "model", minimum: int = 5) -> None:
    few = metrics.groupBy(by).agg(F.count_distinct("seed").alias("n")).where(F.col("n") < minimum)
    names = [r[0] for r in few.limit(20).collect()]
    if names:
        raise ValueError(f"at least {minimum} seeds needed, too few for {few.count()}, among them {names}")


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric columns to rows ``(keys, metric, value)``."""
    names = [c for c in wide.columns if c not in keys]
    cast = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return cast.unpivot(list(keys), names, "metric", "value")


def summarize_seeds(metrics: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, sample standard deviation (0 for one seed) and 95 % interval per key and metric."""
    grouped = metrics.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count("value").alias("seeds"),
    )
    return grouped.withColumn("ci95", 1.96 * F.col("std") / F.sqrt(F.col("seeds").cast("double")))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to about 1e-15.

    Below 3 from the series of erf, above from the continued fraction; both
    unrolled to a fixed number of terms, so the value stays a plain expression.
    """
    square = x * x
    # Horner form of erf(x) = 2x/sqrt(pi) exp(-x^2) sum_k (2x^2)^k / (2k+1)!!
    series = F.lit(1.0)
    for k in range(60, 0, -1):
        series = 1.0 + series * (2.0 * square / (2 * k + 1))
    small = 1.0 - 1.1283791670955126 * x * F.exp(-square) * series
    fraction = x
    for k in range(60, 0, -1):
        fraction = x + (k / 2.0) / fraction
    large = F.exp(-square) / (fraction * 1.7724538509055160)
    return F.when(x < 3.0, small).otherwise(large)


def paired_significance(metrics: DataFrame, reference: DataFrame, metric: str = "AUPRC", key: str = "arm") -> DataFrame:
    """Paired t statistic and normal-tail p value of every arm against one reference, by seed.

    ``metrics`` is ``(key, seed, metric, value)``; ``reference`` is ``(seed,
    metric, value)``. Equal differences give an infinite statistic, no
    difference gives 0, fewer than two common seeds give a status only.
    """
    ref = reference.where(F.col("metric") == metric).select("seed", F.col("value").alias("_ref"))
    pairs = metrics.where(F.col("metric") == metric).join(ref, "seed", "left")
    stats = pairs.groupBy(key).agg(
        F.count("_ref").alias("n"),
        F.avg(F.col("value") - F.col("_ref")).alias("_mean"),
        F.stddev_samp(F.col("value") - F.col("_ref")).alias("_std"),
    )
    enough = F.col("n") >= 2
    t = (
        F.when(~enough, None)
        .when(F.col("_std") == 0.0, F.when(F.col("_mean") != 0.0, float("inf")).otherwise(0.0))
        .otherwise(F.col("_mean") / F.nullif(F.col("_std") / F.sqrt(F.col("n").cast("double")), F.lit(0.0)))
    )
    with_t = stats.withColumn("statistic", t)
    distance = F.abs("statistic") / 1.4142135623730951
    p = F.when(distance > 26.0, 0.0).otherwise(erfc(distance))
    return with_t.select(
        key,
        F.lit("paired_t_test").alias("test"),
        F.lit(metric).alias("metric"),
        "n",
        "statistic",
        F.when(enough, p).alias("p_value"),
        F.when(enough, "tested").otherwise("insufficient_pairs").alias("status"),
    )


def beats_floor(metrics: DataFrame, model: str, floor: str, metric: str = "AUPRC") -> DataFrame:
    """One row: does the model's mean strictly exceed that of the floor model?"""
    means = metrics.where(F.col("metric") == metric).agg(
        F.avg(F.when(F.col("model") == model, F.col("value"))).alias("model_mean"),
        F.avg(F.when(F.col("model") == floor, F.col("value"))).alias("floor_mean"),
    )
    return means.withColumn("beats_floor", F.col("model_mean") > F.col("floor_mean"))


def top_candidates(scored: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return top_per_key(scored, keys, [F.desc("score"), F.asc("tail")], k)
