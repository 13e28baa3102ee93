"""Quality rules: counts over whole texts, then robust multivariate outliers, in DataFrame functions only.

Five statistics of a document, on logarithmic scales, form its vector. For each language and source
the minimum-covariance-determinant estimate is found by concentration steps: distances from the current
mean and covariance, the nearest share of the group, mean and covariance of those. A step is one
aggregation over all groups at once, so no group meets in one task. Documents whose squared
Mahalanobis distance from their group's estimate is above a chi-square quantile are rejected.

Cases: a null or empty text has no word and fails the base rules; null is a language and a
source of its own; groups of fewer than ``MIN_ROWS`` documents are judged by the estimate over their whole language and, if
that is still too small, over the whole corpus; fewer than ``MIN_ROWS`` there reject nothing. Equal documents have equal
verdicts; repeated rows count each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.llm.common import SPACES, materialize, words

#: Smallest group with an estimate of its own, share of a group that the estimate rests on, concentration steps.
MIN_ROWS, SHARE, STEPS = 100, 0.75, 6
#: Quantiles of the chi-square distribution with five degrees of freedom: one half, and 1 - 1e-6.
HALF, CUTOFF = 4.351, 35.888
#: Least standard deviation of each statistic: most documents have no symbol and no repeated line, which is no measure of spread.
#: The range of each statistic, in these, is more than the root of CUTOFF, so each can reject alone.
FLOORS = {"length": 0.3, "word_length": 0.08, "symbols": 0.35, "lines": 0.35, "repeats": 0.55}
#: Added to variances, so that statistics in a line have an inverse.
RIDGE = 1e-6
STATISTICS = tuple(FLOORS)
_WINDOW = 8


def repeated_words(word_list: Column) -> Column:
    """Words in runs of eight that occur twice or more in the text."""
    windows = F.when(F.size(word_list) >= _WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(word_list) - (_WINDOW - 1)), lambda i: F.xxhash64(F.slice(word_list, i, F.lit(_WINDOW)))))
    return windows


def statistics(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Struct ``row`` of the columns ``keep``, the base counts, and the vector of statistics."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    filled = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    split = documents.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("_text")).select(
        "row", words(F.col("_text")).alias("_words"), F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), filled.alias("_lines"))
    windowed = split.select(
        "row", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("_words")).alias("_windows"))
    found_twice = F.size("_windows") > F.size(F.array_distinct("_windows"))
    # only texts with a repetition are sorted; neighbours of equal hash give the places of repeated windows
    ordered = windowed.withColumn("_sorted", F.when(found_twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_sorted")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    placed = ordered.withColumn("_places", F.when(found_twice, F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))))
    steps = F.zip_with("_places", F.slice("_places", 2, F.size("_places")), lambda a, b: F.coalesce(F.least(b - a, F.lit(_WINDOW)), F.lit(_WINDOW)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda total, step: total + step), F.lit(0)).cast("long")
    counted = placed.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "_n_lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    some = F.greatest("n_words", F.lit(1))
    vector = {
        "length": F.log1p("n_words"),
        "word_length": F.log(F.greatest("word_chars", F.lit(1)) / some),
        "symbols": F.log1p(100 * F.col("n_symbols") / some),
        "lines": F.log1p(10 * F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))),
        "repeats": F.log1p(100 * F.col("n_repeat_words") / some),
    }
    return counted.withColumn("base_failed", failed).select("*", *[c.alias(n) for n, c in vector.items()]).drop("_n_lines")


def _grouped(rows: DataFrame, language: Column, source: Column) -> DataFrame:
    """Add ``group``, whose estimate judges a row, and ``groups``, whose estimates the row enters.

    A group is language and source, the whole language of sources that are too few, or the whole corpus.
    """
    named = rows.select("*", F.to_json(F.struct(language.alias("l"), source.alias("s"))).alias("_own"), F.to_json(F.struct(language.alias("l"))).alias("_wider"))
    sizes = materialize(named.where(~F.col("base_failed")).groupBy("_own", "_wider").agg(F.count(F.lit(1)).alias("_n")))
    wider = materialize(sizes.groupBy("_wider").agg(F.sum("_n").alias("_all"), F.min("_n").alias("_least")))
    few = wider.agg(F.coalesce(F.min("_all") < MIN_ROWS, F.lit(False)).alias("_few"))
    own, whole = F.col("_n") >= MIN_ROWS, F.col("_all") >= MIN_ROWS
    entered = F.array(F.when(own, F.col("_own")), F.when(whole & (F.col("_least") < MIN_ROWS), F.col("_wider")), F.when(F.col("_few"), F.lit("all")))
    known = sizes.join(wider, "_wider").crossJoin(F.broadcast(few)).select(
        "_own", F.when(own, F.col("_own")).when(whole, F.col("_wider")).otherwise("all").alias("group"), F.array_compact(entered).alias("groups"))
    return named.join(known, "_own", "left").withColumn("group", F.coalesce("group", F.lit("all"))).drop("_own", "_wider")


def _inverse(matrix: Column, d: int) -> Column:
    """Inverse of a positive definite array of rows, by elimination on the matrix and the unit matrix side by side."""
    unit = F.transform(matrix, lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0))))

    def eliminate(rows: Column, k: Column) -> Column:
        lead = F.get(rows, k)
        return F.transform(rows, lambda row, i: F.when(i == k, F.transform(row, lambda v: v / F.get(lead, k))).otherwise(
            F.zip_with(row, lead, lambda v, p: v - F.get(row, k) * p / F.get(lead, k))))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), unit, eliminate), lambda row: F.slice(row, d + 1, d))


def _estimates(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per group n, ``mean`` and ``precision``, the inverse covariance; sums are combined before the shuffle."""
    d = range(len(names))
    sums = [F.sum(names[i]).alias(f"s_{i}") for i in d] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i in d for j in d if j <= i]
    out = materialize(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *sums))
    floor = list(FLOORS.values())

    def covariance(i: int, j: int) -> Column:
        found = F.col(f"q_{max(i, j)}_{min(i, j)}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n")
        return F.greatest(found, F.lit(floor[i] ** 2)) + RIDGE if i == j else found

    matrix = F.array(*[F.array(*[covariance(i, j) for j in d]) for i in d])
    return out.select("group", "n", F.array(*[F.col(f"s_{i}") / F.col("n") for i in d]).alias("mean"), _inverse(matrix, len(names)).alias("precision"))


def _start(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Medians and quartile ranges: an estimate of mean and spread that outliers do not move."""
    d = range(len(names))
    quartiles = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile_approx(names[i], [0.25, 0.5, 0.75], 1000).alias(f"p_{i}") for i in d])
    floor = list(FLOORS.values())
    spread = [F.greatest(F.pow((F.col(f"p_{i}")[2] - F.col(f"p_{i}")[0]) / 1.349, 2), F.lit(floor[i] ** 2)) for i in d]
    return quartiles.select("group", "n", F.array(*[F.col(f"p_{i}")[1] for i in d]).alias("mean"), F.array(*[
        F.array(*[1 / spread[i] if i == j else F.lit(0.0) for j in d]) for i in d]).alias("precision"))


def _distances(rows: DataFrame, estimates: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add ``distance``: squared Mahalanobis distance from the group's estimate; null where there is none."""
    d = range(len(names))
    columns = [*rows.columns]
    apart = [F.col(n) - F.col("mean")[i] for i, n in enumerate(names)]
    terms = [apart[i] * apart[j] * F.col("precision")[i][j] * (1 if i == j else 2) for i in d for j in d if j <= i]
    return rows.join(estimates.select("group", "mean", "precision"), "group", "left").select(*columns, reduce(lambda a, b: a + b, terms).alias("distance"))


def robust_estimates(rows: DataFrame, names: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Per group: rows, mean, precision, and ``scale``, which makes the median distance that of a normal sample."""
    estimates = materialize(_start(rows, names))
    for _ in range(STEPS):
        far = _distances(rows, estimates, names)
        limits = far.groupBy("group").agg(F.percentile_approx("distance", F.lit(SHARE), 1000).alias("_limit"))
        nearest = far.join(limits, "group").where(F.col("distance") <= F.col("_limit"))
        estimates = materialize(_estimates(nearest, names))
    middle = _distances(rows, estimates, names).groupBy("group").agg(
        F.count(F.lit(1)).alias("rows"), F.percentile_approx("distance", F.lit(0.5), 1000).alias("_median"))
    return materialize(estimates.join(middle, "group").withColumn("scale", F.greatest(F.lit(1.0), F.col("_median") / HALF)).drop("_median"))


def verdicts(documents: DataFrame, keep: list[str], language: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Struct ``row``, base counts, base_failed, distance (null without an estimate) and kept."""
    # stored first: a filter on the counts would move into the expressions over words and compute them again
    read = materialize(statistics(documents.withColumns({"_language": F.col(language), "_source": F.col(source)}), [*keep, "_language", "_source"]))
    grouped = materialize(_grouped(read, F.col("row._language"), F.col("row._source")))
    sound = grouped.where(~F.col("base_failed")).select(F.explode("groups").alias("group"), *STATISTICS)
    estimates = robust_estimates(sound)
    far = _distances(grouped, estimates, STATISTICS).join(estimates.select("group", "rows", "scale"), "group", "left")
    distance = F.when(F.col("rows") >= MIN_ROWS, F.col("distance") / F.col("scale"))
    return far.select(
        F.struct(*[F.col(f"row.{c}").alias(c) for c in keep]).alias("row"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", distance.alias("distance"), (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"))
