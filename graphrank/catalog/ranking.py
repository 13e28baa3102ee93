"""Queries over target ranking, explanations and case studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.catalog.columns import scratch
from graphrank.catalog.registry import query
from graphrank.catalog.scoring import SEEDS, disease_parts, disease_triples, hash_score
from graphrank.catalog.sql import gene, hexnum, with_tables
from graphrank.functions.vectors import unit
from graphrank.operators import ablation as A
from graphrank.operators import evaluate as E
from graphrank.operators import explain as X
from graphrank.operators import graph as G
from graphrank.operators import propagation as P
from graphrank.operators import scorers as R
from graphrank.operators import splits as S
from graphrank.operators.negatives import sample_negatives
from graphrank.plans import pipeline
from graphrank.plans.binding import Sources, gene_key
from graphrank.plans.lineage import materialize
from graphrank.sources import tables as T

_TOP = "top AS MATERIALIZED (SELECT tail, score, row_number() OVER (ORDER BY score DESC, tail) AS rank FROM pop WHERE tail IN (SELECT tail FROM dg) ORDER BY score DESC, tail LIMIT 20)"
_HITS = "hits AS MATERIALIZED (SELECT h.head, t.tail, t.score, t.rank FROM (SELECT DISTINCT head FROM dg) h, top t)"


def ranked_by_popularity(s: Sources, top_k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Top targets of every head, and the known links."""
    known = materialize(disease_triples(s))
    scored = R.score_by_tail(known.select("tail").distinct(), R.popularity(known))
    return X.rank_targets_by_tail(known.select("head"), scored, known, top_k), known


@query("X1, B1", with_tables("dg pop", """SELECT h.head, h.tail, h.score, CAST(h.rank AS INTEGER) AS rank, d.tail IS NOT NULL AS known, d.tail IS NULL AS hypothesis
    FROM hits h LEFT JOIN dg d ON d.head = h.head AND d.tail = h.tail""", f"{_TOP}, {_HITS}"))
def ranked_targets(s: Sources) -> DataFrame:
    """Flagship: top-20 targets per head by popularity, known or hypothesis."""
    return ranked_by_popularity(s)[0]


@query("X1, X11", with_tables("dg", f"""SELECT head, tail, score, CAST(rank AS INTEGER) AS rank FROM (SELECT head, tail, {hexnum("md5(concat_ws('|', head, tail))", 1, 8)} / CAST(4294967296 AS DOUBLE) AS score,
    row_number() OVER (PARTITION BY head ORDER BY {hexnum("md5(concat_ws('|', head, tail))", 1, 8)} DESC, tail) AS rank FROM dg) WHERE rank <= 5"""))
def ranked_candidates(s: Sources) -> DataFrame:
    """Best five of each head's scored candidates."""
    known = disease_triples(s)
    scored = known.withColumn("score", hash_score(F.col("head"), F.col("tail")))
    return X.rank_targets(scored, known, 5).select("head", "tail", "score", "rank")


_LABELS = f"""attr AS (SELECT 'Gene' AS node_type, {gene('p_partkey')} AS node_id, upper(p_name) AS symbol, NULL AS label FROM part
    UNION ALL SELECT 'Disease', 'C' || c_custkey, NULL, c_name FROM customer)"""


@query("X2, X3", f"""SELECT q AS query, coalesce(min(id) FILTER (WHERE p = 0), min(id) FILTER (WHERE p = 1)) AS node_id FROM (SELECT DISTINCT lower(p_name) AS q FROM part UNION SELECT lower({gene('p_partkey')}) FROM part)
    JOIN (SELECT lower({gene('p_partkey')}) AS name, 0 AS p, {gene('p_partkey')} AS id FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = p_partkey
    UNION ALL SELECT lower(p_name), 1, {gene('p_partkey')} FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = p_partkey) ON name = q GROUP BY q""")
def found_genes(s: Sources) -> DataFrame:
    """Look up every part by its name and by its id, in lower case."""
    nodes = G.build_nodes(s.edges("gene_pathway"), s.node_attributes())
    part = s.table("part")
    queries = part.select(F.explode(F.array(F.lower("p_name"), F.lower(gene_key(F.col("p_partkey"))))).alias("query"))
    return X.find_nodes(nodes, "gene", queries)


# --------------------------------------------------------------------------- paths


# every path of every hit, ranked; the hits are the 3 most popular parts of every head
_HITS3 = "hits AS MATERIALIZED (SELECT h.head, t.tail FROM (SELECT DISTINCT head FROM dg) h, (SELECT tail FROM pop WHERE tail IN (SELECT tail FROM dg) ORDER BY score DESC, tail LIMIT 3) t)"
_SHARED = """shared AS MATERIALIZED (SELECT h.head, h.tail, 'disease->gene->pathway->gene' AS schema, 'shared_pathway' AS evidence, k.tail AS gene, a.tail AS pathway, 1 + 1 / CAST(s.n AS DOUBLE) AS score
    FROM hits h JOIN gp a ON a.head = h.tail JOIN gp b ON b.tail = a.tail JOIN dg k ON k.head = h.head AND k.tail = b.head
    JOIN (SELECT tail, count(*) AS n FROM gp GROUP BY 1) s ON s.tail = a.tail)"""
_NEAR = """near AS MATERIALIZED (SELECT DISTINCT h.head, h.tail, 'disease->gene->PPI->gene' AS schema, 'ppi_neighbor_of_known_target' AS evidence, k.tail AS gene, CAST(NULL AS VARCHAR) AS pathway, CAST(0.9 AS DOUBLE) + 1 / CAST(d.n AS DOUBLE) AS score
    FROM hits h JOIN (SELECT head AS a, tail AS b FROM gg UNION SELECT tail, head FROM gg) n ON n.a = h.tail JOIN dg k ON k.head = h.head AND k.tail = n.b
    JOIN (SELECT node, count(*) AS n FROM (SELECT head AS node FROM gg UNION ALL SELECT tail FROM gg) GROUP BY 1) d ON d.node = k.tail)"""
_ORDER = "score DESC, schema DESC, evidence DESC, gene, pathway NULLS FIRST"
_PATHS = f"""paths AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY {_ORDER}) AS path_rank FROM (SELECT * FROM shared UNION ALL SELECT * FROM near)) WHERE path_rank <= 8)"""


def _top3_paths(s: Sources) -> tuple[DataFrame, DataFrame]:
    ranked, known = ranked_by_popularity(s, 3)
    hits = materialize(ranked)
    return hits, X.rank_paths(hits, known, s.edges("gene_pathway"), s.edges("gene_gene"), 8)


@query("X4", with_tables("dg pop gp", f"""SELECT head, tail, gene, pathway, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY {_ORDER}) AS r FROM shared) WHERE r <= 4""", f"{_HITS3}, {_SHARED}"))
def pathway_paths(s: Sources) -> DataFrame:
    """Best four shared-pathway paths of every hit."""
    ranked, known = ranked_by_popularity(s, 3)
    paths = X.shared_pathway_paths(ranked, known, s.edges("gene_pathway"), 4)
    best = X.top_per_key(paths, ["head", "tail"], [F.desc("score"), F.asc("gene"), F.asc("pathway")], 4)
    return best.select("head", "tail", "gene", "pathway", F.round("score", 9).alias("score"))


@query("X5, G18", with_tables("dg pop gg", "SELECT head, tail, gene, round(score, 9) AS score FROM near", f"{_HITS3}, {_NEAR}"))
def neighbour_paths(s: Sources) -> DataFrame:
    ranked, known = ranked_by_popularity(s, 3)
    pairs = s.gene_gene().select(F.col("gene_a").alias("src"), F.col("gene_b").alias("dst"))
    return X.neighbour_paths(ranked, known, pairs).select("head", "tail", "gene", F.round("score", 9).alias("score"))


@query("X6", with_tables("dg pop gp gg", "SELECT head, tail, CAST(path_rank AS INTEGER) AS path_rank, schema, evidence, gene, pathway, round(score, 9) AS score FROM paths", f"{_HITS3}, {_SHARED}, {_NEAR}, {_PATHS}"))
def ranked_paths(s: Sources) -> DataFrame:
    paths = _top3_paths(s)[1]
    return paths.select("head", "tail", "path_rank", "schema", "evidence", "gene", "pathway", F.round("score", 9).alias("score"))


@query("X6, C22", with_tables("dg pop gp gg", """SELECT p.head, p.tail, CAST(path_rank AS INTEGER) AS path_rank, concat_ws(' > ', c.label, g.symbol, p.pathway, t.symbol) AS labels,
    CASE WHEN pathway IS NULL THEN 'associated_with > interacts' ELSE 'associated_with > participates_in > participates_in' END AS relations
    FROM paths p JOIN attr c ON c.node_id = p.head JOIN attr g ON g.node_id = p.gene JOIN attr t ON t.node_id = p.tail""", f"{_HITS3}, {_SHARED}, {_NEAR}, {_PATHS}, {_LABELS}"))
def labelled_paths(s: Sources) -> DataFrame:
    nodes = G.build_nodes(s.edges("disease_gene", "gene_pathway"), s.node_attributes())
    records = X.path_records(_top3_paths(s)[1], nodes)
    return records.select(
        "head", "tail", "path_rank",
        F.concat_ws(" > ", F.transform("nodes", lambda n: n["label"])).alias("labels"),
        F.concat_ws(" > ", F.transform("edges", lambda e: e["rel"])).alias("relations"),
    )


@query("X1, X2, X4, X5, X6", with_tables("dg pop gp gg", """SELECT h.tail, CAST(h.rank AS INTEGER) AS rank, h.score, d.tail IS NOT NULL AS known, (SELECT count(*) FROM paths p WHERE p.tail = h.tail) AS paths
    FROM hits h LEFT JOIN dg d ON d.head = h.head AND d.tail = h.tail""", f"{_TOP}, hits AS MATERIALIZED (SELECT 'C42' AS head, tail, score, rank FROM top), {_SHARED}, {_NEAR}, {_PATHS}"))
def prediction(s: Sources) -> DataFrame:
    """Targets of one customer, found by its name in any case, with nested explanations."""
    edges = s.edges("disease_gene", "gene_pathway", "gene_gene")
    nodes = G.build_nodes(s.edges("disease_gene"), s.node_attributes())
    out = pipeline.predict(edges, nodes, "customer#000000042")
    return out.select("tail", "rank", "score", "known", F.coalesce(F.size("paths"), F.lit(0)).cast("bigint").alias("paths"))


# --------------------------------------------------------------------------- edge rationales

_PREDICTIONS = [("C42", gene_id) for gene_id in ("ENSG00000000000", "ENSG00000000020")]
_RATIONALE = """rel AS MATERIALIZED (SELECT * FROM typed2 WHERE rel LIKE '%associated_with' OR rel LIKE '%participates_in' OR rel = 'interacts'),
    raw AS MATERIALIZED (SELECT g AS gene, st, rel, tt, head, tail, CAST(0.05 AS DOUBLE) + CASE WHEN (st = 'disease' AND head = 'C42') OR (st = 'gene' AND head = g) THEN CAST({w} AS DOUBLE) ELSE 0 END
        + CASE WHEN (tt = 'disease' AND tail = 'C42') OR (tt = 'gene' AND tail = g) THEN CAST({w} AS DOUBLE) ELSE 0 END
        + CASE WHEN (rel = 'associated_with' AND head = 'C42' AND tail = g) OR (rel = 'rev_associated_with' AND head = g AND tail = 'C42') THEN 1 ELSE 0 END AS w
        FROM rel, (VALUES ('ENSG00000000000'), ('ENSG00000000020')) p(g)),
    weights AS MATERIALIZED (SELECT gene, concat_ws('__', st, rel, tt) AS edge_type, head AS src, tail AS dst, round(w / max(w) OVER (PARTITION BY gene, st, rel, tt), 9) AS weight FROM raw),
    chosen AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY weight DESC, layer, edge_type, src, dst) AS rank FROM weights, (VALUES (0), (1)) l(layer))"""


def _rationales(s: Sources, endpoint_weight: float) -> DataFrame:
    typed = G.with_reverse(G.typed_edges(s.edges("disease_gene", "gene_pathway", "gene_gene")))
    return X.edge_rationales(typed, _PREDICTIONS, endpoint_weight).withColumn("weight", F.round("weight", 9))


@query("X7", with_tables("typed2", "SELECT gene, edge_type, src, dst, weight FROM weights WHERE edge_type <> 'gene__interacts__gene'", _RATIONALE.replace("{w}", "0.70")))
def edge_rationales(s: Sources) -> DataFrame:
    weights = _rationales(s, X.ENDPOINT_WEIGHT).where("edge_type <> 'gene__interacts__gene'")
    return weights.select("gene", "edge_type", "src", "dst", "weight")


@query("X8", with_tables("typed2", "SELECT gene, layer, edge_type, src, dst, weight, CAST(rank AS INTEGER) AS rank FROM chosen WHERE rank <= 20", _RATIONALE.replace("{w}", "0.70")))
def top_rationales(s: Sources) -> DataFrame:
    top = X.top_edges(_rationales(s, X.ENDPOINT_WEIGHT), 20, layers=2)
    return top.select("gene", "layer", "edge_type", "src", "dst", "weight", "rank")


@query("X9", with_tables("typed2", "SELECT gene, edge_type, round(sum(weight), 6) AS weight FROM chosen WHERE rank <= 200 GROUP BY 1, 2", _RATIONALE.replace("{w}", "0.70")))
def relation_summary(s: Sources) -> DataFrame:
    top = X.top_edges(_rationales(s, X.ENDPOINT_WEIGHT), 200, layers=2)
    return X.relation_summary(top).select("gene", "edge_type", F.round("weight", 6).alias("weight"))


@query("X10, X11", with_tables("typed2", "SELECT gene, edge_type, weight, count(*) AS edges FROM weights GROUP BY 1, 2, 3", _RATIONALE.replace("{w}", "0.60")))
def edge_masks(s: Sources) -> DataFrame:
    masks = _rationales(s, X.MASK_ENDPOINT_WEIGHT)
    return masks.groupBy("gene", "edge_type", "weight").agg(F.count(F.lit(1)).alias("edges"))


# sparse features of documents and embeddings stand for two node types of a linear scorer
_ATTR = """ft AS MATERIALIZED (SELECT 'gene' AS node_type, CAST(vec_id AS VARCHAR) AS node_id, unnest(range(64)) AS feature_idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
    UNION ALL SELECT 'disease', CAST(c_custkey AS VARCHAR), 0, c_acctbal FROM customer UNION ALL SELECT 'disease', CAST(c_custkey AS VARCHAR), 1, CAST(c_nationkey AS DOUBLE) FROM customer),
    att AS MATERIALIZED (SELECT node_type, node_id, feature_idx, abs(x * (feature_idx - 1.5)) AS a FROM ft),
    ni AS MATERIALIZED (SELECT node_type, node_id, s / max(s) OVER (PARTITION BY node_type) AS importance FROM (SELECT node_type, node_id, sum(a) AS s FROM att GROUP BY 1, 2)),
    fi AS MATERIALIZED (SELECT node_type, feature_idx, s / max(s) OVER (PARTITION BY node_type) AS importance FROM (SELECT node_type, feature_idx, avg(a) AS s FROM att GROUP BY 1, 2))"""


def _attributions(s: Sources) -> DataFrame:
    indices = F.array(*[F.lit(i) for i in range(64)])
    genes = s.table("embeddings").select(F.lit("gene").alias("node_type"), F.col("vec_id").cast("string").alias("node_id"),
                                         indices.alias("indices"), F.col("embedding").cast("array<double>").alias("entries"))
    diseases = s.table("customer").select(F.lit("disease"), F.col("c_custkey").cast("string"), F.array(F.lit(0), F.lit(1)),
                                          F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")))
    weights = s.spark.range(64).select(
        F.explode(F.array(F.lit("gene"), F.lit("disease"))).alias("node_type"),
        F.col("id").cast("int").alias("feature_idx"), (F.col("id") - 1.5).alias("weight"),
    )
    return X.linear_attributions(genes.union(diseases), weights)


def _type_sizes(s: Sources) -> DataFrame:
    genes = s.table("embeddings").agg(F.count(F.lit(1)).alias("nodes")).select(F.lit("gene").alias("node_type"), "nodes")
    return genes.unionByName(s.table("customer").agg(F.count(F.lit(1)).alias("nodes")).select(F.lit("disease").alias("node_type"), "nodes"))


@query("X13", f"WITH {_ATTR} SELECT node_type, node_id, round(importance, 6) AS importance FROM ni")
def node_importance(s: Sources) -> DataFrame:
    return X.node_importance(_attributions(s)).withColumn("importance", F.round("importance", 6))


@query("X13", f"WITH {_ATTR} SELECT node_type, CAST(feature_idx AS INTEGER) AS feature_idx, round(importance, 6) AS importance FROM fi")
def feature_importance(s: Sources) -> DataFrame:
    return X.feature_importance(_attributions(s), _type_sizes(s)).withColumn("importance", F.round("importance", 6))


_SUBGRAPH = f"""{_RATIONALE.replace('{w}', '0.60')}, {_ATTR},
    nn AS (SELECT 'node' AS kind, node_type AS type, node_id AS name, round(importance, 6) AS importance FROM ni QUALIFY row_number() OVER (PARTITION BY node_type ORDER BY round(importance, 6) DESC, node_id) <= 8),
    ee AS (SELECT 'edge' AS kind, edge_type AS type, src || '>' || dst AS name, weight AS importance FROM weights WHERE gene = 'ENSG00000000000' QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY weight DESC, src, dst) <= 12),
    ff AS (SELECT 'feature' AS kind, node_type AS type, CAST(feature_idx AS VARCHAR) AS name, round(importance, 6) AS importance, row_number() OVER (PARTITION BY node_type ORDER BY round(importance, 6) DESC, feature_idx) AS rank FROM fi QUALIFY rank <= 8)"""


@query("X12, X13, X11", with_tables("typed2", """SELECT kind, type, name, importance, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (ORDER BY importance DESC, type, name) AS rank FROM nn QUALIFY rank <= 8 UNION ALL SELECT *, row_number() OVER (ORDER BY importance DESC, type, name) AS rank FROM ee QUALIFY rank <= 12 UNION ALL SELECT * FROM ff)""", _SUBGRAPH))
def explanatory_subgraph(s: Sources) -> DataFrame:
    attributions = _attributions(s)
    masks = _rationales(s, X.MASK_ENDPOINT_WEIGHT).where(F.col("gene") == _PREDICTIONS[0][1])
    return X.explanatory_subgraph(
        X.node_importance(attributions).withColumn("importance", F.round("importance", 6)), masks,
        X.feature_importance(attributions, _type_sizes(s)).withColumn("importance", F.round("importance", 6)),
    )


# --------------------------------------------------------------------------- case studies

# two part names stand for the known targets, two words of part names for the keywords
_TARGETS, _WORDS = ("no such part", "ENSG00000000007", "ENSG00000000003"), ("steel", "small", "red", "pathway", "shared")
_SCORED = f"""sc AS MATERIALIZED (SELECT 'C42' AS head, {gene('p_partkey')} AS tail, {hexnum("md5(concat_ws('|', p_name, CAST(p_partkey AS VARCHAR)))", 1, 8)} / CAST(4294967296 AS DOUBLE) AS score FROM part WHERE p_size < 10),
    genes AS MATERIALIZED (SELECT DISTINCT head AS gene FROM gp)"""


def _scored_genes(s: Sources) -> DataFrame:
    rows = s.table("part").where("p_size < 10")
    return rows.select(F.lit("C42").alias("head"), gene_key(F.col("p_partkey")).alias("tail"), hash_score(F.col("p_name"), F.col("p_partkey")))


@query("X14, X3", with_tables("gp", f"""SELECT * FROM (VALUES ('ENSG00000000007', 'ENSG00000000007', 1), ('ENSG00000000003', 'ENSG00000000003', 2)) v(symbol, gene, ordinal) WHERE gene IN (SELECT head FROM gp)"""))
def known_targets(s: Sources) -> DataFrame:
    nodes = G.build_nodes(s.edges("gene_pathway"), s.node_attributes())
    return X.known_targets(nodes, _TARGETS)


@query("X15", with_tables("dg gp", """SELECT gene, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, gene) AS INTEGER) AS rank FROM (SELECT gene, score FROM genes LEFT JOIN sc ON tail = gene
    WHERE gene NOT IN (SELECT tail FROM dg WHERE head = 'C42') ORDER BY score DESC NULLS LAST, gene LIMIT 500)""", _SCORED))
def novel_predictions(s: Sources) -> DataFrame:
    """More predictions are asked for than are scored, so unscored genes follow."""
    genes = s.gene_pathway().select(F.col("gene_id").alias("gene"))
    return X.novel_predictions(_scored_genes(s), disease_triples(s), genes, "C42", 500)


_CASES = f"""{_SCORED}, kt AS (SELECT * FROM (VALUES ('ENSG00000000007', 0), ('ENSG00000000003', 1)) v(gene, o) WHERE gene IN (SELECT gene FROM genes)),
    cs AS MATERIALIZED (SELECT gene, NULL AS score, true AS known_target, o FROM kt UNION ALL SELECT * FROM (SELECT gene, score, false, 1000 + row_number() OVER (ORDER BY score DESC NULLS LAST, gene) AS o FROM genes LEFT JOIN sc ON tail = gene
        WHERE gene NOT IN (SELECT tail FROM dg WHERE head = 'C42') AND gene NOT IN (SELECT gene FROM kt) ORDER BY o LIMIT 4)),
    cases AS MATERIALIZED (SELECT gene, upper(p_name) AS symbol, score, known_target, NOT known_target AS hypothesis, row_number() OVER (ORDER BY o) AS case_no FROM cs JOIN part ON gene = {gene('p_partkey')})"""


def _cases(s: Sources) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, all nodes and known links."""
    nodes = materialize(G.build_nodes(s.edges("disease_gene", "gene_pathway"), s.node_attributes()))
    known = materialize(disease_triples(s))
    return materialize(X.select_cases(nodes, _scored_genes(s), known, "C42", _TARGETS, 6)), nodes, known


@query("X16", with_tables("dg gp", "SELECT 'C42' AS disease, gene, symbol, score, known_target, hypothesis, CAST(case_no AS INTEGER) AS case_no FROM cases", _CASES))
def selected_cases(s: Sources) -> DataFrame:
    return _cases(s)[0]


_STORY = f"""{_CASES}, hits AS MATERIALIZED (SELECT 'C42' AS head, gene AS tail FROM cases), {_SHARED}, {_NEAR}, {_PATHS},
    txt AS MATERIALIZED (SELECT p.tail, lower(concat_ws(' ', c.c_name, upper(g.p_name), p.pathway, upper(t.p_name), p.evidence)) AS x FROM paths p JOIN customer c ON 'C' || c_custkey = p.head
        JOIN part g ON {gene('g.p_partkey')} = p.gene JOIN part t ON {gene('t.p_partkey')} = p.tail),
    kw AS MATERIALIZED (SELECT tail, string_agg(DISTINCT k, ', ' ORDER BY k) AS terms FROM txt, (VALUES {', '.join(f"('{w}')" for w in _WORDS)}) w(k) WHERE contains(x, k) GROUP BY tail),
    np AS MATERIALIZED (SELECT tail, count(*) AS paths FROM paths GROUP BY tail)"""


def _case_paths(s: Sources) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, their paths and the keywords in them."""
    cases, nodes, known = _cases(s)
    hits = cases.select(F.col("disease").alias("head"), F.col("gene").alias("tail"))
    paths = materialize(X.rank_paths(hits, known, s.edges("gene_pathway"), s.edges("gene_gene"), 8))
    labels = nodes.select("node_id", F.coalesce("symbol", "label").alias("label"))
    return cases, paths, X.keyword_hits(paths, labels, _WORDS)


@query("X17", with_tables("dg gp gg", "SELECT np.tail, coalesce(terms, '') AS terms FROM np LEFT JOIN kw USING (tail)", _STORY))
def keyword_alignment(s: Sources) -> DataFrame:
    return _case_paths(s)[2].select("tail", F.concat_ws(", ", "terms").alias("terms"))


def _text(sql: str) -> str:
    return sql.replace("'", "''")


@query("X18, X16, X17", with_tables("dg gp gg", f"""SELECT CASE WHEN known_target THEN 'known_target_' ELSE 'novel_hypothesis_' END || lower(symbol) AS name, gene, coalesce(paths, 0) AS paths,
    symbol || CASE WHEN known_target THEN '{_text(X._KNOWN_TEXT)}' ELSE '{_text(X._NOVEL_TEXT)}' END
    || CASE WHEN paths > 0 THEN printf('{_text(X._PATHS_TEXT)}', paths) ELSE '{_text(X._NO_PATHS_TEXT)}' END
    || CASE WHEN terms IS NOT NULL THEN '{_text(X._TERMS_TEXT)}' || terms || '.' ELSE '{_text(X._NO_TERMS_TEXT)}' END || '{_text(X._CAVEAT_TEXT)}' AS narrative
    FROM cases LEFT JOIN np ON np.tail = gene LEFT JOIN kw ON kw.tail = gene""", _STORY))
def case_narratives(s: Sources) -> DataFrame:
    """Case studies as records, written and read back."""
    cases, paths, terms = _case_paths(s)
    counts = paths.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("paths"))
    folder = scratch(s.spark, "cases")
    T.write_records(X.case_narratives(cases, counts, terms), folder)
    return s.spark.read.schema("name string, gene string, paths bigint, narrative string").json(folder)


# --------------------------------------------------------------------------- design grid

#: Components of an embedding, and those that ids and texts are hashed to.
_WIDTH = 64


def _grid_features(s: Sources, links: DataFrame) -> DataFrame:
    """Node vectors for the four feature choices, ``(features, node_type, node_id, x)``: of two numbers for the structure, else of ``_WIDTH``."""
    nodes = links.select(F.explode(F.array(
        F.struct(F.lit("disease").alias("node_type"), F.col("src").alias("node_id")),
        F.struct(F.lit("gene").alias("node_type"), F.col("dst").alias("node_id")),
    )).alias("_n")).select("_n.*").distinct()
    ranks = P.pagerank(S.message_links(links).select("src", "dst"))
    degree = G.undirected_degrees(S.message_links(links))
    structure = nodes.join(degree.withColumnRenamed("node", "node_id"), "node_id", "left").join(
        ranks.withColumnRenamed("node", "node_id"), "node_id", "left"
    ).select("node_type", "node_id", F.array(F.log1p(F.coalesce("degree", F.lit(0)).cast("double")),
                                             1000 * F.coalesce("pagerank", F.lit(0.0))).alias("x"))
    number = F.regexp_extract("node_id", "([0-9]+)$", 1).cast("bigint")
    embedded = nodes.withColumn("vec_id", number).join(
        s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "left"
    ).select("node_type", "node_id", F.coalesce("v", F.array_repeat(F.lit(0.0), _WIDTH)).alias("x"))
    names = s.table("part").select(F.lit("gene").alias("node_type"), gene_key(F.col("p_partkey")).alias("node_id"), F.col("p_name").alias("t")).unionByName(
        s.table("customer").select(F.lit("disease").alias("node_type"), F.concat(F.lit("C"), "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("t"))
    )
    from graphrank.functions.vectors import id_vector

    hot = nodes.select("node_type", "node_id", id_vector(F.col("node_id"), _WIDTH).alias("x"))
    text = names.select("node_type", "node_id", id_vector(F.col("t"), _WIDTH).alias("x"))
    out = None
    for name, x in zip(A.FEATURE_CHOICES, (hot, structure, embedded, text)):
        part = x.select(F.lit(name).alias("features"), "node_type", "node_id", "x")
        out = part if out is None else out.unionByName(part)
    return out


@query("A8, A2, A3, A7, N9, N10, E11")
def design_grid(s: Sources) -> DataFrame:
    """36 cells: negatives x hops x features, scored by cosine of propagated vectors, five seeds in one pass.

    Links, cells and seeds are columns of one table: no job per cell.
    """
    parts = disease_parts(s)
    message = materialize(S.message_links(parts))
    positives = S.supervision_links(parts, "test", 1).select("edge_type", "src", "dst")
    n = positives.count()
    heads = parts.select("edge_type", F.col("src").alias("id"))
    tails = parts.select("edge_type", F.col("dst").alias("id"))
    ends = F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")))
    degrees = message.select("edge_type", F.explode(ends).alias("_e")).groupBy("edge_type", "_e.side", "_e.id").agg(F.count(F.lit(1)).alias("degree"))
    hard = message.join(s.gene_gene().select(F.col("gene_a").alias("dst"), F.col("gene_b").alias("near")), "dst").select(
        "edge_type", "src", F.col("near").alias("dst"))
    links = None
    for strategy in A.NEGATIVE_CHOICES:
        drawn = sample_negatives(heads, tails, parts, {"associated_with": n}, 13, "grid", strategy, degrees, hard)
        rows = positives.withColumn("label", F.lit(1)).unionByName(drawn.withColumn("label", F.lit(0)))
        rows = rows.select(F.lit(strategy).alias("negative_sampling"), F.col("src").alias("head"), F.col("edge_type").alias("relation"),
                           F.col("dst").alias("tail"), "label")
        links = rows if links is None else links.unionByName(rows)
    typed = materialize(G.with_reverse(message.select(
        F.lit("disease").alias("src_type"), F.col("edge_type").alias("relation"), F.lit("gene").alias("dst_type"), "src", "dst")))
    vectors, features = None, materialize(_grid_features(s, parts))
    for name in A.FEATURE_CHOICES:
        x = features.where(F.col("features") == name).drop("features")
        for layers in A.LAYER_CHOICES:
            x = materialize(P.relation_means(typed, x, 2 if name == "structural" else _WIDTH))
            made = x.select(F.lit(name).alias("features"), F.lit(layers).alias("num_layers"), F.col("node_id").alias("node"), unit(F.col("x")).alias("vector"))
            vectors = made if vectors is None else vectors.unionByName(made)
    cell = ["features", "num_layers"]
    # a seed leaves out a fifth of the links, another fifth for each
    fold = F.pmod(F.hash("head", "tail"), F.lit(5))
    seeds = F.explode(F.array(*[F.struct(F.lit(seed).alias("seed"), F.lit(i).alias("fold")) for i, seed in enumerate(SEEDS)])).alias("_s")
    left, right = (vectors.select(*cell, F.col("node").alias(c), F.col("vector").alias(v)) for c, v in (("head", "_h"), ("tail", "_t")))
    scored = links.join(left, "head").join(right, [*cell, "tail"]).select(
        A.cell_name(F.col("negative_sampling"), F.col("num_layers"), F.col("features")).alias("arm"), "head", "relation", "tail", "label",
        F.aggregate(F.zip_with("_h", "_t", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v).alias("score"),
    ).withColumn("_fold", fold).select("*", seeds).where("_fold <> _s.fold").select("arm", "_s.seed", "head", "relation", "tail", "label", "score")
    scored = materialize(scored)
    keys = ["arm", "seed"]
    known = parts.select(F.col("src").alias("head"), F.col("edge_type").alias("relation"), F.col("dst").alias("tail"))
    metrics = materialize(A.standardize_metrics(E.long_metrics(E.evaluate_scores(scored, known, keys).drop("num_positives", "num_negatives"), keys)))
    A.check_arms(metrics, [r["arm"] for r in A.design_grid(s.spark).collect()])
    report = A.finalize_report(metrics, A.reference_cell())
    narrative = A.narrative_grid(metrics).select("narrative").scalar()
    return report.withColumn("narrative", narrative)
