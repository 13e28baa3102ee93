"""Link scorers. A scorer adds ``score`` to rows with ``head, relation, tail``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.functions.vectors import cosine, dot, id_vector, pair_features, with_node_features
from graphrank.operators.graph import neighbours
from graphrank.operators.kge import KgeFit, fit_kge  # noqa: F401
from graphrank.operators.ordering import dense_index
from graphrank.operators.propagation import pagerank, structural_embeddings

KGE_MODELS = ("TransE", "DistMult", "ComplEx", "RotatE")


# --------------------------------------------------------------------------- per-tail scores


def popularity(triples: DataFrame) -> DataFrame:
    """``(tail, score)``: occurrences as tail plus occurrences at either end."""
    ends = F.array(
        F.struct(F.col("head").alias("tail"), F.lit(1).alias("_w")),
        F.struct(F.col("tail").alias("tail"), F.lit(2).alias("_w")),
    )
    return (
        triples.select(F.explode(ends).alias("_e")).groupBy(F.col("_e.tail").alias("tail"))
        .agg(F.sum("_e._w").cast("double").alias("score"))
    )


def centrality(triples: DataFrame, iterations: int = 50) -> DataFrame:
    """``(tail, score)``: PageRank plus degree on the undirected simple graph (a self-loop has degree 2)."""
    pairs = triples.select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    loop = (F.col("node") == F.col("neighbour")).cast("int")
    degree = neighbours(pairs).groupBy("node").agg(F.sum(1 + loop).alias("_degree"))
    return pagerank(pairs, iterations).join(degree, "node").select(
        F.col("node").alias("tail"), (F.col("pagerank") + F.col("_degree")).alias("score")
    )


def score_by_tail(candidates: DataFrame, tail_scores: DataFrame) -> DataFrame:
    """Candidates with the score of their tail, 0 for tails without one."""
    return candidates.join(tail_scores.select("tail", "score"), "tail", "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    ).select(*candidates.columns, "score")


# --------------------------------------------------------------------------- embeddings and decoders


def with_end_vectors(candidates: DataFrame, vectors: DataFrame, fallback_dim: int | None = None) -> DataFrame:
    """Add ``_h`` and ``_t``, the vectors of both ends; missing ones are hashed ids or null."""
    heads = vectors.select(F.col("node").alias("head"), F.col("vector").alias("_h"))
    tails = vectors.select(F.col("node").alias("tail"), F.col("vector").alias("_t"))
    joined = candidates.join(heads, "head", "left").join(tails, "tail", "left")
    if fallback_dim is None:
        return joined
    return joined.withColumn("_h", F.coalesce("_h", id_vector(F.col("head"), fallback_dim))).withColumn(
        "_t", F.coalesce("_t", id_vector(F.col("tail"), fallback_dim))
    )


def cosine_scores(candidates: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Cosine of the end vectors; an end without a vector uses the hashed vector of its id."""
    both = with_end_vectors(candidates, vectors, dim)
    return both.select(*candidates.columns, cosine(F.col("_h"), F.col("_t")).alias("score"))


def structure_scores(triples: DataFrame, dim: int = 16, iterations: int = 20) -> Callable[[DataFrame], DataFrame]:
    vectors = structural_embeddings(triples.select(F.col("head").alias("src"), F.col("tail").alias("dst")), dim, iterations)
    return lambda candidates: cosine_scores(candidates, vectors, dim)


def dot_scores(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Dot product of the end vectors, 0 where an end is unknown."""
    both = with_end_vectors(candidates, vectors)
    return both.select(*candidates.columns, F.coalesce(dot(F.col("_h"), F.col("_t")), F.lit(0.0)).alias("score"))


def diagonal_scores(candidates: DataFrame, vectors: DataFrame, relations: DataFrame) -> DataFrame:
    """Dot product weighted by the relation's diagonal ``(relation, weight array)``."""
    both = with_end_vectors(candidates, vectors).join(F.broadcast(relations), "relation", "left")  # relations are a few names of the schema
    product = F.zip_with(F.col("_h"), F.col("weight"), lambda x, w: x * w)
    return both.select(*candidates.columns, F.coalesce(dot(product, F.col("_t")), F.lit(0.0)).alias("score"))


def decode(candidates: DataFrame, vectors: DataFrame, decoder: str = "dot", relations: DataFrame | None = None,
           model=None) -> DataFrame:
    """Score links with the named decoder: ``dot``, ``distmult`` or ``mlp``."""
    if decoder == "dot":
        return dot_scores(candidates, vectors)
    if decoder == "distmult":
        if relations is None:
            raise ValueError("distmult needs the relation weights")
        return diagonal_scores(candidates, vectors, relations)
    if decoder == "mlp":
        if model is None:
            raise ValueError("mlp needs a fitted model")
        return perceptron_scores(model, candidates, vectors)
    raise ValueError(f"unknown decoder {decoder}")


def relation_losses(scored: DataFrame, relation: str = "edge_type") -> DataFrame:
    """Mean binary cross-entropy of logits per relation, in a form that cannot overflow."""
    loss = F.greatest("score", F.lit(0.0)) - F.col("score") * F.col("label") + F.log1p(F.exp(-F.abs("score")))
    return scored.groupBy(relation).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("links"))


def multitask_loss(scored: DataFrame, relation: str = "edge_type") -> DataFrame:
    """Relations weigh the same, whatever their number of links."""
    return relation_losses(scored, relation).agg(F.avg("loss").alias("loss"))


# --------------------------------------------------------------------------- knowledge-graph embeddings


def kge_scores(candidates: DataFrame, entities: DataFrame, relations: DataFrame, model: str = "TransE") -> DataFrame:
    """Compatibility of ``(head, relation, tail)``, 0 where anything is unknown.

    ``entities`` is ``(node, vector)``, ``relations`` is ``(relation, weight)``.
    RotatE is scored like TransE and ComplEx as the diagonal product plus h.t.
    """
    if model not in KGE_MODELS:
        raise ValueError(f"unknown model {model}; one of {KGE_MODELS}")
    both = with_end_vectors(candidates, entities).join(F.broadcast(relations), "relation", "left")
    h, r, t = F.col("_h"), F.col("weight"), F.col("_t")
    if model in ("TransE", "RotatE"):
        gap = F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: x - y)
        score = -F.sqrt(dot(gap, gap))
    else:
        score = dot(F.zip_with(h, r, lambda x, y: x * y), t)
        if model == "ComplEx":
            score = score + dot(h, t)
    return both.select(*candidates.columns, F.coalesce(score, F.lit(0.0)).alias("score"))


# --------------------------------------------------------------------------- fitted scorers


def link_features(candidates: DataFrame, features: DataFrame | None, dim: int = 16) -> DataFrame:
    """Add ``features``: ends, absolute difference and product. ``features`` is ``(node_id, vector)``."""
    out = candidates
    for column, name in (("head", "_h"), ("tail", "_t")):
        out = with_node_features(out, column, features, name, dim)
    return out.withColumn("features", pair_features(F.col("_h"), F.col("_t"))).drop("_h", "_t")


def fit_logistic(examples: DataFrame, l2: float = 1e-4, max_iter: int = 100) -> LogisticRegressionModel:
    """Logistic regression on ``(features, label)``."""
    ready = examples.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(regParam=l2, elasticNetParam=0.0, maxIter=max_iter, standardization=False).fit(ready)


def logistic_scores(model: LogisticRegressionModel, candidates: DataFrame, features: DataFrame | None, dim: int = 16) -> DataFrame:
    """Logit of each candidate."""
    ready = link_features(candidates, features, dim)
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients.toArray()])
    return ready.select(*candidates.columns, (dot(F.col("features"), weights) + float(model.intercept)).alias("score"))


def _concatenated(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    both = with_end_vectors(candidates, vectors).where("_h is not null and _t is not null")
    return both.withColumn("features", array_to_vector(F.concat("_h", "_t"))).drop("_h", "_t")


def fit_perceptron(examples: DataFrame, vectors: DataFrame, width: int, max_iter: int = 50, seed: int = 13):
    """Two-layer perceptron on the concatenated end vectors of labelled links."""
    ready = _concatenated(examples, vectors).select("features", F.col("label").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[2 * width, width, 2], maxIter=max_iter, seed=seed).fit(ready)


def perceptron_scores(model, candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Probability of each candidate, 0 where an end is unknown."""
    both = with_end_vectors(candidates, vectors)
    zeros = F.array_repeat(F.lit(0.0), model.numFeatures // 2)
    ready = both.select(*candidates.columns, (F.col("_h").isNotNull() & F.col("_t").isNotNull()).alias("_known"),
                        array_to_vector(F.concat(F.coalesce("_h", zeros), F.coalesce("_t", zeros))).alias("features"))
    score = F.when(F.col("_known"), vector_to_array("probability")[1]).otherwise(0.0)
    return model.transform(ready).select(*candidates.columns, score.alias("score"))


def fit_factors(positives: DataFrame, rank: int = 8, max_iter: int = 10, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """Latent factors of heads and tails ``(node, vector)`` from alternating least squares on links."""
    heads = dense_index(positives.select(F.col("head").alias("node")).distinct(), [], [F.col("node")])
    tails = dense_index(positives.select(F.col("tail").alias("node")).distinct(), [], [F.col("node")])
    ratings = (
        positives.select("head", "tail").distinct()
        .join(heads.select(F.col("node").alias("head"), F.col("idx").cast("int").alias("user")), "head")
        .join(tails.select(F.col("node").alias("tail"), F.col("idx").cast("int").alias("item")), "tail")
        .select("user", "item", F.lit(1.0).alias("rating"))
    )
    model = ALS(rank=rank, maxIter=max_iter, implicitPrefs=True, seed=seed, userCol="user", itemCol="item",
                ratingCol="rating", coldStartStrategy="nan").fit(ratings)

    def named(factors: DataFrame, index: DataFrame) -> DataFrame:
        return factors.join(index, factors["id"] == index["idx"]).select(
            "node", F.col("features").cast("array<double>").alias("vector")
        )

    return named(model.userFactors, heads), named(model.itemFactors, tails)


def factor_scores(candidates: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """Dot product of head and tail factors, 0 for ends without factors."""
    both = candidates.join(heads.select(F.col("node").alias("head"), F.col("vector").alias("_h")), "head", "left").join(
        tails.select(F.col("node").alias("tail"), F.col("vector").alias("_t")), "tail", "left"
    )
    return both.select(*candidates.columns, F.coalesce(dot(F.col("_h"), F.col("_t")), F.lit(0.0)).alias("score"))


def row_scorer(function: Callable[[Sequence, Sequence, Sequence], Sequence]) -> Callable[[DataFrame], DataFrame]:
    """Scorer from a vectorised Python function of head, relation and tail series."""
    @F.pandas_udf("double")
    def apply(head: pd.Series, relation: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series(function(head, relation, tail), index=head.index, dtype="float64")

    return lambda candidates: candidates.withColumn("score", apply("head", "relation", "tail"))
