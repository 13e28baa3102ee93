"""Ranking of targets and explanations of ranked links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphrank.functions.columns import LABEL_COLUMNS, display_label, relation_key
from graphrank.operators.graph import neighbours, undirected_degrees
from graphrank.operators.ordering import top_per_key
from graphrank.plans.lineage import materialize

MAX_TOP_K = 100  # bound of a ranked list for one query
PATHWAY_SCHEMA, LINK_SCHEMA = "disease->gene->pathway->gene", "disease->gene->PPI->gene"
PATHWAY_EVIDENCE, LINK_EVIDENCE = "shared_pathway", "ppi_neighbor_of_known_target"
# --- fixed values: weights of the edge rationales
BASE_WEIGHT, ENDPOINT_WEIGHT, MASK_ENDPOINT_WEIGHT, EXACT_WEIGHT = 0.05, 0.70, 0.60, 1.0
# --- fixed values: known targets and keywords of the field
KNOWN_TARGETS = ("GDF5", "MMP13")
KEYWORDS = (
    "wnt",
    "beta-catenin",
    "tgf",
    "bmp",
    "cartilage",
    "extracellular matrix",
    "collagen",
    "matrix metalloproteinase",
)
# --- fixed values: sentences of the case studies
_KNOWN_TEXT = (
    " is treated as a known-target sanity check. The rationale should recover OA-relevant neighborhood "
    "evidence rather than be read as a new discovery."
)
_NOVEL_TEXT = (
    " is a computational hypothesis generated from the model ranking. It is not a validated osteoarthritis "
    "target and requires independent biological validation."
)
_PATHS_TEXT = " Top-ranked paths include %d shared-pathway or PPI rationales."
_NO_PATHS_TEXT = " No compact shared-pathway or PPI rationale was found in the current graph."
_TERMS_TEXT = " Detected OA biology terms: "
_NO_TERMS_TEXT = " No Wnt/TGF-beta/BMP/PPI biology keyword was detected in this small graph."
_CAVEAT_TEXT = (
    " Heterogeneous explainers remain an immature interface, so these masks and attention values are "
    "qualitative support for inspection, not causal proof."
)


# --------------------------------------------------------------------------- ranking


def _check_top_k(top_k: int) -> None:
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be within 1..{MAX_TOP_K}")


def find_nodes(nodes: DataFrame, node_type: str, queries: DataFrame) -> DataFrame:
    """Node id of each ``query`` text, by id or label in any case; a match on the id wins."""
    typed = nodes.where(F.lower("node_type") == node_type.lower())
    names = F.array(
        F.struct(F.lit(0).alias("_p"), F.lower("node_id").alias("_name")),
        *[
            F.struct(F.lit(i + 1).alias("_p"), F.lower(F.col(c)).alias("_name"))
            for i, c in enumerate(LABEL_COLUMNS)
            if c in nodes.columns
        ],
    )
    named = typed.select("node_id", F.explode(names).alias("_n")).select("node_id", "_n.*").where("_name is not null")
    wanted = queries.select("query").distinct().withColumn("_name", F.lower("query"))
    best = named.join(wanted, "_name").groupBy("query").agg(F.min(F.struct("_p", "node_id")).alias("_best"))
    return best.select("query", F.col("_best.node_id").alias("node_id"))


def find_node(nodes: DataFrame, node_type: str, query: str) -> str:
    """Node id of one query text; KeyError when there is none."""
    queries = nodes.sparkSession.createDataFrame([(query,)], "query string")
    hit = find_nodes(nodes, node_type, queries).first()
    if hit is None:
        raise KeyError(f"{node_type} not found: {query}")
    return hit["node_id"]


def _flagged(ranked: DataFrame, known: DataFrame) -> DataFrame:
    links = known.select("head", "tail").distinct().withColumn("_known", F.lit(True))
    known_flag = F.coalesce("_known", F.lit(False))
    return ranked.join(links, ["head", "tail"], "left").select(
        *ranked.columns, known_flag.alias("known"), (~known_flag).alias("hypothesis")
    )


def rank_targets(scored: DataFrame, known: DataFrame, top_k: int = 20) -> DataFrame:
    """Best ``top_k`` scored tails per head with rank and known / hypothesis flags."""
    _check_top_k(top_k)
    best = top_per_key(scored.select("head", "tail", "score"), ["head"], [F.desc("score"), F.asc("tail")], top_k)
    return _flagged(best, known)


def rank_targets_by_tail(heads: DataFrame, tail_scores: DataFrame, known: DataFrame, top_k: int = 20) -> DataFrame:
    """:func:`rank_targets` for a score that depends on the tail only.

    ``tail_scores`` has one row per possible target. All heads share one list of ``top_k`` tails, so heads x tails is never
    built: the list (at most 100 entries) is one array attached to every head.
    """
    _check_top_k(top_k)
    best = tail_scores.select("tail", "score").orderBy(F.desc("score"), F.asc("tail")).limit(top_k)
    entry = F.struct((-F.col("score")).alias("_down"), "tail", "score")
    listed = best.agg(F.array_sort(F.collect_list(entry)).alias("_list")).scalar()
    ranked = heads.select("head").distinct().select("head", F.posexplode(listed).alias("_i", "_e"))
    return _flagged(
        ranked.select("head", "_e.tail", "_e.score", (F.col("_i") + 1).alias("rank")), known
    )


# --------------------------------------------------------------------------- paths


def shared_pathway_paths(
    hits: DataFrame, known: DataFrame, memberships: DataFrame, per_hit: int = 10, exclude_self: bool = False
) -> DataFrame:
    """Paths head - known gene - pathway - candidate for every hit ``(head, tail)``.

    Scored ``1 + 1 / pathway size``. Only paths that can be among the first
    ``per_hit`` of a hit are made: the score depends on the pathway alone, so a
    hit needs its smallest pathways, and of each the first known genes in id
    order. The pairs inside a pathway are never listed.
    """
    member = memberships.select(F.col("source_id").alias("gene"), F.col("target_id").alias("pathway"))
    sizes = member.groupBy("pathway").agg(F.count(F.lit(1)).alias("_size"))
    member = member.distinct()
    links = known.select("head", F.col("tail").alias("gene")).distinct().join(
        hits.select("head").distinct(), "head", "left_semi"
    )
    # one more gene than asked for, in case the candidate itself is skipped
    room = per_hit + (1 if exclude_self else 0)
    tails = hits.select("head", "tail").distinct().join(
        member.select(F.col("gene").alias("tail"), "pathway"), "tail"
    )
    # pathways no hit belongs to are dropped before links fan out, those no hit of the head belongs to before genes are ranked
    used = member.join(tails.select("pathway").distinct(), "pathway", "left_semi")
    reached = links.join(used, "gene").join(tails.select("head", "pathway"), ["head", "pathway"], "left_semi")
    first_genes = top_per_key(reached.select("head", "pathway", "gene"), ["head", "pathway"], [F.asc("gene")], room, "_g")
    # one row per head and pathway
    covered = first_genes.groupBy("head", "pathway").agg(
        F.array_sort(F.collect_list("gene")).alias("_genes")
    )
    own = tails.join(covered, ["head", "pathway"]).join(sizes, "pathway")
    if exclude_self:
        own = own.withColumn("_genes", F.array_remove("_genes", F.col("tail"))).where(F.size("_genes") > 0)
    # a hit keeps the pathways of its `per_hit` smallest sizes, ties included
    smallest = F.rank().over(Window.partitionBy("head", "tail").orderBy("_size"))
    few = own.withColumn("_r", smallest).where(F.col("_r") <= per_hit)
    return few.select("head", "tail", "pathway", "_size", F.explode("_genes").alias("gene")).select(
        "head", "tail",
        F.lit(PATHWAY_SCHEMA).alias("schema"),
        F.lit(PATHWAY_EVIDENCE).alias("evidence"),
        "gene", "pathway",
        (1.0 + 1.0 / F.greatest(F.col("_size"), F.lit(1)).cast("double")).alias("score"),
    )


def neighbour_paths(hits: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paths head - known gene - candidate over undirected gene links, scored ``0.9 + 1 / degree``.

    Hits meet the known genes of their head (hits are bounded per head) that are next to any hit, and
    the pairs are then looked up among the links: a hub's links are not fanned out.
    """
    degree = undirected_degrees(pairs).withColumnRenamed("node", "gene")
    around = neighbours(pairs).select(F.col("node").alias("tail"), F.col("neighbour").alias("gene"))
    around = around.join(hits.select("tail").distinct(), "tail", "left_semi")
    beside = known.select("head", F.col("tail").alias("gene")).distinct().join(around.select("gene").distinct(), "gene", "left_semi")
    meeting = hits.select("head", "tail").distinct().join(beside, "head")
    return meeting.join(around, ["tail", "gene"], "left_semi").join(degree, "gene").select(
        "head", "tail",
        F.lit(LINK_SCHEMA).alias("schema"),
        F.lit(LINK_EVIDENCE).alias("evidence"),
        "gene", F.lit(None).cast("string").alias("pathway"),
        (0.9 + 1.0 / F.greatest(F.col("degree"), F.lit(1)).cast("double")).alias("score"),
    )


def rank_paths(
    hits: DataFrame, known: DataFrame, memberships: DataFrame, gene_pairs: DataFrame, max_paths: int = 10,
    exclude_self: bool = False,
) -> DataFrame:
    """Best paths of every hit: by score, schema and evidence descending, then gene and pathway ascending."""
    pairs = gene_pairs.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    paths = shared_pathway_paths(hits, known, memberships, max_paths, exclude_self).unionByName(
        neighbour_paths(hits, known, pairs)
    )
    order = [F.desc("score"), F.desc("schema"), F.desc("evidence"), F.asc("gene"), F.asc_nulls_first("pathway")]
    return top_per_key(paths, ["head", "tail"], order, max_paths, "path_rank")


def path_records(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths with their nodes as ``array<struct<node_type, node_id, label>>`` and their relations."""
    labels = nodes.select(F.lower("node_type").alias("_t"), "node_id", display_label(nodes).alias("_label"))

    def labelled(df: DataFrame, column: str, node_type: str) -> DataFrame:
        names = labels.where(F.col("_t") == node_type).select(F.col("node_id").alias(column), F.col("_label").alias(f"_{column}"))
        return df.join(names, column, "left")

    out = paths
    for column, node_type in (("head", "disease"), ("gene", "gene"), ("pathway", "pathway"), ("tail", "gene")):
        out = labelled(out, column, node_type)

    def node(column: str, node_type: str) -> Column:
        return F.struct(
            F.lit(node_type).alias("node_type"), F.col(column).alias("node_id"),
            F.coalesce(f"_{column}", column).alias("label"),
        )

    def step(src: str, rel: str, dst: str) -> Column:
        return F.struct(F.lit(src).alias("src"), F.lit(rel).alias("rel"), F.lit(dst).alias("dst"))

    shared = F.col("schema") == PATHWAY_SCHEMA
    first, middle, last = node("head", "disease"), node("gene", "gene"), node("tail", "gene")
    hop = step("disease", "associated_with", "gene")
    member = step("gene", "participates_in", "pathway")
    return out.select(
        "head", "tail", "path_rank", "schema", "evidence", "score",
        F.when(shared, F.array(first, middle, node("pathway", "pathway"), last)).otherwise(F.array(first, middle, last)).alias("nodes"),
        F.when(shared, F.array(hop, member, member)).otherwise(F.array(hop, step("gene", "interacts", "gene"))).alias("edges"),
    )


def explained_ranking(ranked: DataFrame, paths: DataFrame) -> DataFrame:
    """Ranked rows with their paths nested in rank order (at most ``max_paths`` per row)."""
    entry = F.struct("path_rank", "schema", "evidence", "gene", "pathway", F.col("score").alias("path_score"))
    nested = paths.groupBy("head", "tail").agg(F.array_sort(F.collect_list(entry)).alias("paths"))
    return ranked.join(nested, ["head", "tail"], "left")


# --------------------------------------------------------------------------- edge rationales


def edge_rationales(
    typed: DataFrame, predictions: Sequence[tuple[str, str]], endpoint_weight: float = ENDPOINT_WEIGHT
) -> DataFrame:
    """Weight of every edge for each (disease, gene) prediction, at most 1 per relation.

    Base weight, plus ``endpoint_weight`` for each end that is the disease or
    the gene, plus 1 for the predicted link itself or its reverse, divided by
    the relation's largest weight. The predictions are a short list (at most
    100), so each edge is compared with literals in the scan.
    """
    if not 1 <= len(predictions) <= MAX_TOP_K:
        raise ValueError(f"1 to {MAX_TOP_K} predictions")
    listed = F.array(*[F.struct(F.lit(d).alias("disease"), F.lit(g).alias("gene")) for d, g in predictions])
    rows = typed.withColumn("_p", F.explode(listed)).select("_p.*", *typed.columns)

    def match(type_column: str, id_column: str) -> Column:
        is_disease = (F.col(type_column) == "disease") & (F.col(id_column) == F.col("disease"))
        is_gene = (F.col(type_column) == "gene") & (F.col(id_column) == F.col("gene"))
        return F.when(is_disease | is_gene, endpoint_weight).otherwise(0.0)

    forward = (
        (F.col("src_type") == "disease") & (F.col("relation") == "associated_with") & (F.col("dst_type") == "gene")
        & (F.col("src") == F.col("disease")) & (F.col("dst") == F.col("gene"))
    )
    backward = (
        (F.col("src_type") == "gene") & F.col("relation").startswith("rev_") & (F.col("dst_type") == "disease")
        & (F.col("src") == F.col("gene")) & (F.col("dst") == F.col("disease"))
    )
    exact = F.when(forward | backward, EXACT_WEIGHT).otherwise(0.0)
    raw = rows.withColumn(
        "_raw", F.lit(BASE_WEIGHT) + match("src_type", "src") + match("dst_type", "dst") + exact
    )
    # one row per prediction and relation, from partial maxima
    keys = ["disease", "gene", "src_type", "relation", "dst_type"]
    highest = raw.groupBy(*keys).agg(F.max("_raw").alias("_max"))
    return raw.join(F.broadcast(highest), keys).select(
        *keys, "src", "dst",
        relation_key(F.col("src_type"), F.col("relation"), F.col("dst_type")).alias("edge_type"),
        normalized(F.col("_raw"), F.col("_max")).alias("weight"),
    )


def normalized(value: Column, maximum: Column) -> Column:
    """``value / maximum``, 0 when the maximum is not positive."""
    return F.when(maximum > 0, value / maximum).otherwise(0.0)


def top_edges(weights: DataFrame, top_k: int = 20, layers: int = 1) -> DataFrame:
    """Heaviest edges per prediction over all layers; ties by layer, relation and ends.

    Layers repeat the same weights, so ``top_k`` edges are found first and repeated then.
    """
    key = ["disease", "gene"]
    order = [F.desc("weight"), F.asc("edge_type"), F.asc("src"), F.asc("dst")]
    best = top_per_key(weights, key, order, top_k, "_r").drop("_r")
    layered = best.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(max(1, layers) - 1))))
    return top_per_key(
        layered, key, [F.desc("weight"), F.asc("layer"), F.asc("edge_type"), F.asc("src"), F.asc("dst")], top_k
    )


def relation_summary(selected: DataFrame) -> DataFrame:
    """Weight of the selected edges per relation."""
    return selected.groupBy("disease", "gene", "edge_type").agg(F.sum("weight").alias("weight"))


# --------------------------------------------------------------------------- attributions


def linear_attributions(features: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Attribution of every feature entry: ``weight * value`` for a linear scorer, else ``|value|``.

    ``features`` is ``(node_type, node_id, indices, entries)`` and ``weights``
    ``(node_type, feature_idx, weight)``. For a linear score the gradient does
    not change along the path from zero, so this is its integrated gradient.
    """
    entry = F.explode(F.arrays_zip("indices", "entries")).alias("_e")
    long = features.select("node_type", "node_id", entry).select(
        "node_type", "node_id", F.col("_e.indices").alias("feature_idx"), F.col("_e.entries").alias("value")
    )
    if weights is None:
        return long.select("node_type", "node_id", "feature_idx", F.abs("value").alias("attribution"))
    return long.join(weights, ["node_type", "feature_idx"]).select(
        "node_type", "node_id", "feature_idx", (F.col("weight") * F.col("value")).alias("attribution")
    )


def node_importance(attributions: DataFrame) -> DataFrame:
    """Sum of absolute attributions per node, divided by the largest of its type."""
    sums = attributions.groupBy("node_type", "node_id").agg(F.sum(F.abs("attribution")).alias("_s"))
    highest = sums.groupBy("node_type").agg(F.max("_s").alias("_max"))
    return sums.join(F.broadcast(highest), "node_type").select(
        "node_type", "node_id", normalized(F.col("_s"), F.col("_max")).alias("importance")
    )


def feature_importance(attributions: DataFrame, nodes_per_type: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature over all nodes of the type, divided by the largest."""
    sums = attributions.groupBy("node_type", "feature_idx").agg(F.sum(F.abs("attribution")).alias("_s"))
    means = sums.join(nodes_per_type, "node_type").withColumn("_m", F.col("_s") / F.col("nodes"))
    highest = means.groupBy("node_type").agg(F.max("_m").alias("_max"))
    return means.join(F.broadcast(highest), "node_type").select(
        "node_type", "feature_idx", normalized(F.col("_m"), F.col("_max")).alias("importance")
    )


def explanatory_subgraph(
    node_scores: DataFrame, edge_weights: DataFrame, feature_scores: DataFrame, top_nodes: int = 8, top_edges_: int = 12,
    top_features: int = 8,
) -> DataFrame:
    """Compact rationale ``(kind, type, name, rank, importance)``.

    Nodes: best per type, then best overall. Edges: best per relation, then
    best overall. Features: best per type.
    """
    nodes = top_per_key(node_scores, ["node_type"], [F.desc("importance"), F.asc("node_id")], top_nodes, "_r").select(
        F.lit("node").alias("kind"), F.col("node_type").alias("type"), F.col("node_id").alias("name"), "importance"
    )
    edge_name = F.concat_ws(">", "src", "dst")
    edges = top_per_key(
        edge_weights, ["edge_type"], [F.desc("weight"), F.asc("src"), F.asc("dst")], top_edges_, "_r"
    ).select(F.lit("edge").alias("kind"), F.col("edge_type").alias("type"), edge_name.alias("name"), F.col("weight").alias("importance"))
    overall = [F.desc("importance"), F.asc("type"), F.asc("name")]
    best = top_per_key(nodes, ["kind"], overall, top_nodes).unionByName(top_per_key(edges, ["kind"], overall, top_edges_))
    features = top_per_key(
        feature_scores, ["node_type"], [F.desc("importance"), F.asc("feature_idx")], top_features
    ).select(F.lit("feature").alias("kind"), F.col("node_type").alias("type"),
             F.col("feature_idx").cast("string").alias("name"), "importance", "rank")
    return best.unionByName(features)


# --------------------------------------------------------------------------- case studies


def _target_order(spark: SparkSession, preferred: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(preferred)], "query string, _order int")


def known_targets(nodes: DataFrame, preferred: Sequence[str] = KNOWN_TARGETS) -> DataFrame:
    """Preferred targets that are in the graph ``(symbol, gene, ordinal)``, in the given order."""
    order = _target_order(nodes.sparkSession, preferred)
    found = find_nodes(nodes, "gene", order.select("query"))
    return order.join(found, "query").select(
        F.col("query").alias("symbol"), F.col("node_id").alias("gene"), F.col("_order").alias("ordinal")
    )


def select_known_target(nodes: DataFrame, preferred: Sequence[str] = KNOWN_TARGETS) -> str:
    first = known_targets(nodes, preferred).orderBy("ordinal").first()
    if first is None:
        raise ValueError(f"none of {tuple(preferred)} is in the graph")
    return first["gene"]


def novel_predictions(
    scored: DataFrame, positives: DataFrame, genes: DataFrame, disease: str, n: int = 1, used: DataFrame | None = None
) -> DataFrame:
    """Best ``n`` genes of a disease outside its positives; unscored genes follow in id order.

    ``scored`` is ``(head, tail, score)``, ``positives`` ``(head, tail)``,
    ``genes`` ``(gene)``. Returns ``(gene, score, rank)``; the score of unscored genes is null.
    """
    taken = positives.where(F.col("head") == disease).select(F.col("tail").alias("gene"))
    if used is not None:
        taken = taken.unionByName(used.select("gene"))
    own = scored.where(F.col("head") == disease).groupBy(F.col("tail").alias("gene")).agg(F.max("score").alias("score"))
    open_ = genes.select("gene").distinct().join(taken, "gene", "left_anti").join(own, "gene", "left")
    first = open_.orderBy(F.desc_nulls_last("score"), F.asc("gene")).limit(n)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), F.asc("gene")))
    return first.withColumn("rank", place)


def select_cases(
    nodes: DataFrame, scored: DataFrame, positives: DataFrame, disease: str, preferred: Sequence[str] = KNOWN_TARGETS,
    minimum: int = 3,
) -> DataFrame:
    """Cases to explain: known targets present, then best novel predictions up to ``minimum``.

    ``(disease, gene, symbol, score, known_target, hypothesis, case_no)``.
    """
    genes = nodes.where(F.lower("node_type") == "gene")
    labels = genes.select(F.col("node_id").alias("gene"), display_label(genes).alias("symbol"))
    known = materialize(known_targets(nodes, preferred))
    missing = max(0, minimum - known.count())
    chosen = known.select("gene", F.lit(None).cast("double").alias("score"), F.lit(True).alias("known_target"),
                          F.col("ordinal").alias("_o"))
    if missing:
        novel = novel_predictions(scored, positives, labels, disease, missing, known)
        chosen = chosen.unionByName(
            novel.select("gene", "score", F.lit(False).alias("known_target"), (F.col("rank") + 1000).alias("_o"))
        )
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o"))
    return chosen.join(labels, "gene").select(
        F.lit(disease).alias("disease"), "gene", "symbol", "score", "known_target",
        (~F.col("known_target")).alias("hypothesis"), number.alias("case_no"),
    )


def keyword_hits(paths: DataFrame, labels: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Sorted keywords in the labels and evidence of each prediction's paths ``(head, tail, terms)``.

    ``labels`` is ``(node_id, label)``.
    """
    def named(column: str) -> DataFrame:
        return labels.select(F.col("node_id").alias(column), F.col("label").alias(f"_{column}"))

    text = paths
    for column in ("head", "gene", "pathway", "tail"):
        text = text.join(named(column), column, "left")
    joined = F.lower(F.concat_ws(" ", "_head", "_gene", "_pathway", "_tail", "evidence"))
    hits = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(joined, k))
    return (
        text.select("head", "tail", F.explode_outer(hits).alias("_term"))
        .groupBy("head", "tail")
        .agg(F.array_sort(F.collect_set("_term")).alias("terms"))
    )


def case_narratives(cases: DataFrame, path_counts: DataFrame, terms: DataFrame) -> DataFrame:
    """Sentence text of every case. ``path_counts`` is ``(head, tail, paths)``, ``terms`` as above."""
    keyed = (
        cases.withColumnsRenamed({"disease": "head", "gene": "tail"})
        .join(path_counts, ["head", "tail"], "left")
        .join(terms, ["head", "tail"], "left")
    )
    paths = F.coalesce("paths", F.lit(0))
    found = F.coalesce("terms", F.array().cast("array<string>"))
    text = F.concat(
        F.col("symbol"),
        F.when(F.col("known_target"), _KNOWN_TEXT).otherwise(_NOVEL_TEXT),
        F.when(paths > 0, F.format_string(_PATHS_TEXT, paths)).otherwise(_NO_PATHS_TEXT),
        F.when(F.size(found) > 0, F.concat(F.lit(_TERMS_TEXT), F.concat_ws(", ", found), F.lit("."))).otherwise(_NO_TERMS_TEXT),
        F.lit(_CAVEAT_TEXT),
    )
    prefix = F.when(F.col("known_target"), "known_target_").otherwise("novel_hypothesis_")
    return keyed.select(
        F.concat(prefix, F.lower("symbol")).alias("name"), F.col("head").alias("disease"), F.col("tail").alias("gene"),
        "symbol", "score", "known_target", "hypothesis", "case_no", paths.alias("paths"),
        F.concat_ws(", ", found).alias("terms"), text.alias("narrative"),
    )
