"""Queries over the typed graph, its statistics and node features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.catalog.columns import scratch
from graphrank.catalog.registry import query
from graphrank.catalog.sql import gene, with_tables
from graphrank.functions import columns as C
from graphrank.operators import features as X
from graphrank.operators import graph as G
from graphrank.operators import propagation as P
from graphrank.plans import pipeline
from graphrank.plans.binding import Sources, gene_key
from graphrank.plans.lineage import materialize
from graphrank.sources import tables as T
from graphrank.streaming import upsert as U

_EDGE_ROWS = "SELECT edge_table, head AS source_id, st AS source_type, rel AS edge_type, tt AS target_type, tail AS target_id FROM edges"


@query("G1, G2", with_tables("edges", _EDGE_ROWS))
def canonical_edges(s: Sources) -> DataFrame:
    return s.edges().select("edge_table", "source_id", "source_type", "edge_type", "target_type", "target_id")


@query("G1-G7, R1-R20 as one job", with_tables("edges", _EDGE_ROWS))
def built_graph(s: Sources) -> DataFrame:
    """Raw sources to stored, checked and reread edges."""
    raw = {
        "associations": s.associations(), "protein_links": s.protein_links(), "proteins": s.protein_file(), "accessions": s.accession_file(),
        "targets": s.target_file(), "mechanisms": s.mechanism_file(), "pathways": s.pathway_file(), "annotations": s.annotation_file(),
        "hierarchy": s.hierarchy_file(),
    }
    edges, _ = pipeline.build_and_store(raw, scratch(s.spark, "built"), disease=None)
    return edges.select("edge_table", "source_id", "source_type", "edge_type", "target_type", "target_id")


@query("S5, S6, G5", with_tables("edges dr1", """SELECT e.edge_table, e.head AS source_id, e.tail AS target_id, d.target AS target_chembl_id, d.action AS action_type
    FROM edges e JOIN dr1 d ON e.head = d.head AND e.tail = d.tail WHERE edge_table = 'drug_gene'"""))
def stored_graph_relation(s: Sources) -> DataFrame:
    """Write the partitioned graph, check it, and read one relation back."""
    folder = scratch(s.spark, "graph")
    T.write_graph(s.edges(), G.build_nodes, folder)
    stored, _ = T.read_graph(s.spark, folder)
    G.assert_edges(stored)
    return stored.where("edge_table = 'drug_gene'").select(
        "edge_table", "source_id", "target_id", "target_chembl_id", "action_type"
    )


_ATTRIBUTES = f"""attr AS (SELECT 'Gene' AS node_type, {gene('p_partkey')} AS node_id, upper(p_name) AS symbol, NULL AS label FROM part
    UNION ALL SELECT 'Disease', 'C' || c_custkey, NULL, c_name FROM customer)"""


@query("G3, G7, R1", with_tables("nodes", """SELECT n.node_type, n.node_id, coalesce(a.label, n.node_id) AS label, a.symbol
    FROM nodes n LEFT JOIN attr a USING (node_type, node_id)""", _ATTRIBUTES))
def node_table(s: Sources) -> DataFrame:
    return s.nodes().select("node_type", "node_id", "label", "symbol")


@query("G4", """SELECT 'drug_gene' AS edge_table, 'missing required edge table' AS error
    UNION ALL SELECT 'gene_go', 'missing required edge table'
    UNION ALL SELECT 'gene_pathway', 'unexpected endpoints Gene-participates_in-Gene'
    UNION ALL SELECT 'part_part', 'unknown edge table'""")
def edge_errors(s: Sources) -> DataFrame:
    """A graph with a wrong, an unknown and two absent tables."""
    wrong = s.edges("gene_pathway").withColumn("target_type", F.lit("Gene"))
    unknown = s.edges("gene_gene").withColumn("edge_table", F.lit("part_part"))
    return G.validate_edges(s.edges("disease_gene", "gene_gene").unionByName(wrong).unionByName(unknown))


@query("G6", with_tables("nodes", "SELECT count(*) AS nodes, count(*) BETWEEN 100 AND 1000000 AS in_range FROM nodes"))
def node_range(s: Sources) -> DataFrame:
    return G.check_node_range(G.build_nodes(s.edges()), 100, 1_000_000)


_TOTALS = """e AS (SELECT CAST(count(*) AS DOUBLE) AS e FROM edges), n AS (SELECT CAST(count(DISTINCT node_id) AS DOUBLE) AS n FROM nodes)"""


@query("G8, G9, G10", with_tables("edges nodes", """SELECT 'node_count' AS metric, node_type AS name, round(CAST(count(DISTINCT node_id) AS DOUBLE), 9) AS value FROM nodes GROUP BY node_type
    UNION ALL SELECT 'edge_count', edge_table, CAST(count(*) AS DOUBLE) FROM edges GROUP BY edge_table
    UNION ALL SELECT 'density', 'global', round(e / (n * (n - 1)), 9) FROM e, n
    UNION ALL SELECT 'mean_degree', 'global', round(2 * e / n, 9) FROM e, n
    UNION ALL SELECT 'positive_disease_gene_links', 'Open Targets', CAST(count(*) AS DOUBLE) FROM edges WHERE edge_table = 'disease_gene'""", _TOTALS))
def graph_statistics(s: Sources) -> DataFrame:
    edges = s.stored_edges()
    return G.graph_statistics(materialize(G.build_nodes(edges)), edges).withColumn("value", F.round("value", 9))


@query("G11", with_tables("edges", """SELECT node_id, count(*) AS degree FROM (SELECT head AS node_id FROM edges UNION ALL SELECT tail FROM edges) GROUP BY 1"""))
def degree_distribution(s: Sources) -> DataFrame:
    return G.degree_distribution(s.edges())


@query("G12", with_tables("nodes", f"""SELECT w.g AS gene, w.g IN (SELECT upper(node_id) FROM nodes UNION SELECT symbol FROM nodes JOIN attr USING (node_type, node_id) WHERE symbol IS NOT NULL) AS present
    FROM (SELECT DISTINCT upper(p_name || p_type) AS g FROM part UNION SELECT upper(p_name) FROM part UNION SELECT {gene('p_partkey')} FROM part) w""", _ATTRIBUTES))
def known_gene_presence(s: Sources) -> DataFrame:
    part = s.table("part")
    wanted = part.select(F.explode(F.array(F.concat("p_name", "p_type"), F.col("p_name"), F.lower(gene_key(F.col("p_partkey"))))).alias("gene"))
    return G.known_gene_presence(s.nodes(), wanted)


@query("G13, C19, C20", with_tables("typed2 nodes", """SELECT 'node_count' AS metric, CASE node_type WHEN 'GOTerm' THEN 'go_term' ELSE lower(node_type) END AS name, CAST(count(*) AS DOUBLE) AS value FROM nodes GROUP BY 2
    UNION ALL SELECT 'edge_count', concat_ws('__', st, rel, tt), CAST(count(*) AS DOUBLE) FROM typed2 GROUP BY 2
    UNION ALL SELECT 'density', 'global', round(e / (n * (n - 1)), 9) FROM t
    UNION ALL SELECT 'mean_degree', 'global', round(2 * e / n, 9) FROM t
    UNION ALL SELECT 'positive_disease_gene_links', 'disease__associated_with__gene', CAST(count(*) AS DOUBLE) FROM typed2 WHERE rel = 'associated_with'""",
    "t AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM typed2) AS e, (SELECT CAST(count(*) AS DOUBLE) FROM nodes) AS n)"))
def typed_graph_statistics(s: Sources) -> DataFrame:
    edges = s.stored_edges()
    return G.typed_statistics(materialize(G.build_nodes(edges)), edges).withColumn("value", F.round("value", 9))


@query("G14, C21, C22", with_tables("typed2 nodes", """SELECT t || ':' || node_id AS id, t AS node_type, node_id, coalesce(symbol, label, node_id) AS label, coalesce(d.degree, 0) AS degree
    FROM (SELECT CASE node_type WHEN 'GOTerm' THEN 'go_term' ELSE lower(node_type) END AS t, node_type, node_id FROM nodes) n
    LEFT JOIN attr a USING (node_type, node_id)
    LEFT JOIN (SELECT t, id, count(*) AS degree FROM (SELECT st AS t, head AS id FROM typed2 UNION ALL SELECT tt, tail FROM typed2) GROUP BY 1, 2) d ON d.t = n.t AND d.id = n.node_id""".replace("SELECT t ||", "SELECT n.t ||").replace(", t AS node_type, node_id, coalesce", ", n.t AS node_type, n.node_id, coalesce"), _ATTRIBUTES))
def node_records(s: Sources) -> DataFrame:
    edges = s.stored_edges()
    return G.node_records(s.nodes(edges), edges)


@query("G14, G17, C20", with_tables("typed2", """SELECT concat_ws('__', st, rel, tt) || ':' || st || ':' || head || '>' || tt || ':' || tail AS id,
    st || ':' || head AS source, tt || ':' || tail AS target, rel AS relation FROM typed2 WHERE rel IN ('interacts', 'rev_participates_in')"""))
def edge_records(s: Sources) -> DataFrame:
    records = G.edge_records(s.edges("gene_gene", "gene_pathway"))
    return records.where("relation <> 'participates_in'").select("id", "source", "target", "relation")


@query("G15, S7", with_tables("nodes", """SELECT CASE node_type WHEN 'GOTerm' THEN 'go_term' ELSE lower(node_type) END AS node_type, node_id,
    row_number() OVER (PARTITION BY node_type ORDER BY node_id) - 1 AS node_idx FROM nodes"""))
def stored_node_index(s: Sources) -> DataFrame:
    folder = scratch(s.spark, "index")
    T.write_node_index(G.node_index(G.build_nodes(s.edges())), folder)
    return T.read_node_index(s.spark, folder)


@query("G16", with_tables("nodes gp", """SELECT a.i AS src_idx, b.i AS dst_idx FROM gp JOIN ix a ON a.node_type = 'Gene' AND a.node_id = gp.head
    JOIN ix b ON b.node_type = 'Pathway' AND b.node_id = gp.tail""",
    "ix AS MATERIALIZED (SELECT node_type, node_id, row_number() OVER (PARTITION BY node_type ORDER BY node_id) - 1 AS i FROM nodes)"))
def edge_index(s: Sources) -> DataFrame:
    index = G.node_index(G.build_nodes(s.edges()))
    typed = G.relation_edges(G.typed_edges(s.edges("gene_pathway")), "gene", "participates_in", "pathway")
    return G.edge_index(typed, index).select("src_idx", "dst_idx")


@query("G18", with_tables("gg", "SELECT head AS node, tail AS neighbour FROM gg UNION SELECT tail, head FROM gg"))
def gene_neighbours(s: Sources) -> DataFrame:
    return G.neighbours(s.gene_gene(), "gene_a", "gene_b")


@query("G18", with_tables("gg", "SELECT node, count(*) AS degree FROM (SELECT head AS node FROM gg UNION ALL SELECT tail FROM gg) GROUP BY 1"))
def gene_link_degrees(s: Sources) -> DataFrame:
    return G.undirected_degrees(s.gene_gene(), "gene_a", "gene_b")


@query("S12", """SELECT 'Order' AS node_type, 'O' || l_orderkey AS node_id, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def repeated_node_keys(s: Sources) -> DataFrame:
    rows = s.table("lineitem").select(F.lit("Order").alias("node_type"), F.concat(F.lit("O"), "l_orderkey").alias("node_id"))
    return G.unique_key_violations(rows)


# --------------------------------------------------------------------------- upsert


@query("S11", """SELECT 'Disease' AS node_type, coalesce('C' || c_custkey, 'C' || k) AS node_id, coalesce(new_segment, CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS segment,
    c_name AS label, orders FROM customer FULL OUTER JOIN (SELECT o_custkey + 5 AS k, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS new_segment, count(*) AS orders FROM orders GROUP BY 1) ON c_custkey = k""")
def merged_nodes(s: Sources) -> DataFrame:
    stored = s.table("customer").select(
        F.lit("Disease").alias("node_type"), F.concat(F.lit("C"), "c_custkey").alias("node_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("label"),
    )
    incoming = s.table("orders").groupBy((F.col("o_custkey") + 5).alias("k")).agg(
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("segment"),
        F.count(F.lit(1)).alias("orders"),
    ).select(F.lit("Disease").alias("node_type"), F.concat(F.lit("C"), "k").alias("node_id"), "segment", "orders")
    return U.merge_nodes(stored, incoming)


@query("S11", with_tables("dg gg", """SELECT 'Gene' AS source_type, coalesce(o.head, n.head) AS source_id, 'interacts' AS edge_type, 'Gene' AS target_type,
    coalesce(o.tail, n.tail) AS target_id, coalesce(n.score, o.score) AS score FROM gg o FULL OUTER JOIN
    (SELECT tail AS head, head AS tail, score + 1 AS score FROM gg WHERE head IN (SELECT g FROM keep) AND tail IN (SELECT g FROM keep)) n ON o.head = n.head AND o.tail = n.tail""",
    f"keep AS (SELECT {gene('p_partkey')} AS g FROM part WHERE p_size < 40)"))
def merged_edges(s: Sources) -> DataFrame:
    """Reversed links are merged into the links; those without both ends are left out."""
    def shaped(a: str, b: str, score) -> DataFrame:
        return s.gene_gene().select(
            F.lit("Gene").alias("source_type"), F.col(a).alias("source_id"), F.lit("interacts").alias("edge_type"),
            F.lit("Gene").alias("target_type"), F.col(b).alias("target_id"), score.alias("score"),
        )

    nodes = s.table("part").where("p_size < 40").select(F.lit("Gene").alias("node_type"), gene_key(F.col("p_partkey")).alias("node_id"))
    return U.merge_edges(shaped("gene_a", "gene_b", F.col("score")), shaped("gene_b", "gene_a", F.col("score") + 1), nodes)


@query("S11, S13", """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts, max(event_id) AS event_id FROM events GROUP BY 1, 2""")
def streamed_upsert(s: Sources) -> DataFrame:
    """Latest event per user and type, merged batch by batch from a stream."""
    schema = s.table("events").schema
    stream = s.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    folder = scratch(s.spark, "upsert")
    rows = stream.select("user_id", "event_type", "ts", "event_id", "value")
    running = U.stream_upsert(
        rows, folder, ["user_id", "event_type"], ["ts", "event_id"], scratch(s.spark, "stream")
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    last = running.lastProgress["batchId"]
    return U.read_upserted(s.spark, folder, last)


# --------------------------------------------------------------------------- features


def pagerank_sql(edges: str, rounds: int) -> str:
    """Recursive expression ``pr`` of undirected PageRank over SELECT text ``edges`` (head, tail)."""
    return f"""adj AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT head AS a, tail AS b FROM ({edges}) UNION ALL SELECT tail, head FROM ({edges}))),
    deg AS MATERIALIZED (SELECT a, count(*) AS d FROM adj GROUP BY a),
    size AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM deg),
    pr AS (SELECT 0 AS it, a AS node, 1 / n AS r FROM deg, size
        UNION ALL SELECT it + 1, adj.b, max((1 - CAST(0.85 AS DOUBLE)) / n) + CAST(0.85 AS DOUBLE) * sum(r / d) FROM pr JOIN adj ON node = adj.a JOIN deg ON deg.a = node, size WHERE it < {rounds} GROUP BY it + 1, adj.b)"""


@query("F1, F2", with_tables("edges", """SELECT node AS node_id, degree, round(r, 9) AS pagerank FROM pr
    JOIN (SELECT id, count(*) AS degree FROM (SELECT head AS id FROM edges UNION ALL SELECT tail FROM edges) GROUP BY 1) ON id = node
    WHERE it = 20 AND node LIKE 'ENSG%'""", pagerank_sql("SELECT head, tail FROM edges", 20), recursive=True))
def gene_structure(s: Sources) -> DataFrame:
    edges = s.stored_edges()
    genes = G.build_nodes(edges).where("node_type = 'Gene'")
    return X.gene_structure(genes, edges).withColumn("pagerank", F.round("pagerank", 9))


@query("F3, F4", with_tables("edges go", """SELECT g.node_id, count(DISTINCT tail) AS width_terms, coalesce(string_agg(CASE WHEN own THEN CAST(i AS VARCHAR) END, ',' ORDER BY i), '') AS indices FROM
    (SELECT n.node_id, t.tail, t.i, go.head IS NOT NULL AS own FROM (SELECT head AS node_id FROM edges WHERE st = 'Gene' UNION SELECT tail FROM edges WHERE tt = 'Gene') n, term t
     LEFT JOIN go ON go.head = n.node_id AND go.tail = t.tail) g GROUP BY g.node_id""",
    "term AS (SELECT tail, row_number() OVER (ORDER BY tail) - 1 AS i FROM (SELECT DISTINCT tail FROM go ORDER BY tail LIMIT 512))"))
def annotation_multihot(s: Sources) -> DataFrame:
    edges = s.stored_edges()
    genes = G.build_nodes(edges).where("node_type = 'Gene'")
    return X.go_multihot(genes, edges.where("edge_type = 'annotated_with'")).select(
        "node_id", F.col("width").alias("width_terms"), F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices")
    )


@query("F5, F6, F11, C14", f"""SELECT 'C' || vec_id AS node_id, CAST(64 AS BIGINT) AS width, embedding[1] AS first_value FROM embeddings""")
def given_vectors(s: Sources) -> DataFrame:
    """Nodes that all have a vector of one width use it."""
    nodes = s.table("embeddings").select(F.lit("Disease").alias("node_type"), F.concat(F.lit("C"), "vec_id").alias("node_id"),
                                         F.col("embedding").alias("text_embedding"))
    return X.disease_features(nodes).select("node_id", "width", F.element_at("entries", 1).cast("float").alias("first_value"))


@query("F6, F4, F5", """SELECT 'C' || c_custkey AS node_id, (SELECT count(*) FROM customer) AS width, row_number() OVER (ORDER BY 'C' || c_custkey) - 1 AS position FROM customer""")
def identity_features(s: Sources) -> DataFrame:
    """One customer without a vector turns the whole type to one-hot rows."""
    vectors = s.table("embeddings").select((F.col("vec_id") + 1).alias("c_custkey"), F.col("embedding").alias("text_embedding"))
    nodes = s.table("customer").select("c_custkey").join(vectors, "c_custkey", "left").select(
        F.lit("Disease").alias("node_type"), F.concat(F.lit("C"), "c_custkey").alias("node_id"), "text_embedding"
    )
    return X.disease_features(nodes).select("node_id", "width", F.col("indices")[0].cast("bigint").alias("position"))


@query("F7, C11", with_tables("dr1", """SELECT head AS node_id, CAST(CAST('0x' || substr(sha256(salt || ':' || head), 1, 16) AS UBIGINT) % 2048 AS BIGINT) AS bit
    FROM (SELECT DISTINCT head FROM dr1), (SELECT unnest(range(32)) AS salt) GROUP BY ALL"""))
def drug_fingerprints(s: Sources) -> DataFrame:
    nodes = G.build_nodes(s.edges("drug_gene"))
    return X.drug_features(nodes).select("node_id", F.explode(F.col("indices").cast("array<bigint>")).alias("bit"))


@query("F8, F9", with_tables("gp pp", """SELECT n.node_id, coalesce(c, 0) AS participants, coalesce(d, 0) AS depth
    FROM (SELECT head AS node_id FROM pp UNION SELECT tail FROM pp UNION SELECT tail FROM gp) n
    LEFT JOIN (SELECT tail, count(*) AS c FROM gp GROUP BY 1) ON tail = node_id
    LEFT JOIN (SELECT id, min(depth) AS d FROM walk GROUP BY 1) ON id = node_id""",
    """walk AS (SELECT DISTINCT head AS id, CAST(0 AS INTEGER) AS depth FROM pp WHERE head NOT IN (SELECT tail FROM pp)
    UNION SELECT pp.tail, depth + 1 FROM walk JOIN pp ON pp.head = id)""", recursive=True))
def pathway_structure(s: Sources) -> DataFrame:
    edges = s.stored_edges("gene_pathway", "pathway_pathway")
    return X.pathway_structure(G.build_nodes(edges), edges)


@query("F10, C16, C8", with_tables("go", """SELECT tail AS node_id, 'BP' AS namespace, round(-ln(count(*) / (SELECT count(*) FROM go)), 6) AS information_content FROM go GROUP BY tail"""))
def term_structure(s: Sources) -> DataFrame:
    edges = s.stored_edges("gene_go")
    return X.term_structure(G.build_nodes(edges), edges).withColumn("information_content", F.round("information_content", 6))


@query("F4, F6, F7, F8, F10", with_tables("nodes", """SELECT node_type, count(*) AS nodes, CAST(max(w) AS BIGINT) AS width FROM (
    SELECT CASE node_type WHEN 'GOTerm' THEN 'go_term' ELSE lower(node_type) END AS node_type,
    CASE node_type WHEN 'Gene' THEN 2 + least(512, (SELECT count(*) FROM nodes WHERE node_type = 'GOTerm')) WHEN 'Disease' THEN count(*) OVER (PARTITION BY node_type)
      WHEN 'Drug' THEN 2048 WHEN 'Pathway' THEN 2 ELSE 4 END AS w FROM nodes) GROUP BY 1"""))
def feature_widths(s: Sources) -> DataFrame:
    edges = s.stored_edges()
    return X.all_features(G.build_nodes(edges), edges, "go").groupBy("node_type").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("width").alias("width")
    )


# numeric features of width 2 (roots, so that no mean lies on a rounding boundary): customers and parts, 0 for pathways
_X = f"""x AS MATERIALIZED (SELECT 'disease' AS t, 'C' || c_custkey AS id, sqrt(abs(c_acctbal)) AS a, 1.0 AS b FROM customer
    UNION ALL SELECT 'gene', {gene('p_partkey')}, sqrt(p_retailprice), sqrt(CAST(p_size AS DOUBLE)) FROM part
    UNION ALL SELECT 'pathway', 'R-HSA-S' || s_suppkey, sqrt(abs(s_acctbal)), 0.0 FROM supplier),
    m AS MATERIALIZED (SELECT tt AS t, tail AS id, st, rel, a, b FROM typed2 JOIN x ON x.t = st AND x.id = head WHERE rel LIKE '%associated_with' OR rel LIKE '%participates_in')"""
_OUT = "round(sum(a), 4) AS first_value, round(sum(b), 4) AS second_value"


def _propagation_inputs(s: Sources) -> tuple[DataFrame, DataFrame]:
    typed = G.with_reverse(G.typed_edges(s.edges("disease_gene", "gene_pathway")))
    customers = s.table("customer").select(F.lit("disease").alias("node_type"), F.concat(F.lit("C"), "c_custkey").alias("node_id"),
                                           F.array(F.sqrt(F.abs("c_acctbal")), F.lit(1.0)).alias("x"))
    parts = s.table("part").select(F.lit("gene"), gene_key(F.col("p_partkey")), F.array(F.sqrt("p_retailprice"), F.sqrt(F.col("p_size").cast("double"))))
    suppliers = s.table("supplier").select(F.lit("pathway"), F.concat(F.lit("R-HSA-S"), "s_suppkey"), F.array(F.sqrt(F.abs("s_acctbal")), F.lit(0.0)))
    return typed, customers.union(parts).union(suppliers)


def _flat(x: DataFrame) -> DataFrame:
    return x.select("node_type", "node_id", F.round(F.col("x")[0], 4).alias("first_value"), F.round(F.col("x")[1], 4).alias("second_value"))


@query("F12", with_tables("typed2", f"""SELECT t AS node_type, id AS node_id, {_OUT} FROM (SELECT t, id, a, b FROM x
    UNION ALL SELECT t, id, avg(a), avg(b) FROM m GROUP BY t, id, st, rel) GROUP BY 1, 2""", _X))
def relation_means(s: Sources) -> DataFrame:
    return _flat(P.relation_means(*_propagation_inputs(s), 2))


@query("F13", with_tables("typed2", f"""SELECT t AS node_type, id AS node_id, {_OUT} FROM (SELECT t, id, a, b FROM x
    UNION ALL SELECT t, id, avg(a), avg(b) FROM m GROUP BY t, id) GROUP BY 1, 2""", _X))
def homogeneous_means(s: Sources) -> DataFrame:
    return _flat(P.homogeneous_means(*_propagation_inputs(s), 2))


_TWO_HOPS = """m1 AS MATERIALIZED (SELECT t, id, avg(a) AS a, avg(b) AS b FROM (SELECT t, id, a, b FROM x UNION ALL SELECT t, id, a, b FROM m) GROUP BY 1, 2),
    m2 AS (SELECT tt AS t, tail AS id, a, b FROM typed2 JOIN m1 ON m1.t = st AND m1.id = head WHERE rel LIKE '%associated_with' OR rel LIKE '%participates_in')"""


@query("F14", with_tables("typed2", """SELECT t AS node_type, id AS node_id, round(avg(a), 4) AS first_value, round(avg(b), 4) AS second_value
    FROM (SELECT t, id, a, b FROM m1 UNION ALL SELECT t, id, a, b FROM m2) GROUP BY 1, 2""", f"{_X}, {_TWO_HOPS}"))
def relational_average(s: Sources) -> DataFrame:
    return _flat(P.relational_average(*_propagation_inputs(s), 2, hops=2))


@query("C20, C21", with_tables("typed2", "SELECT st AS src_type, rel AS relation, tt AS dst_type, count(*) AS edges FROM typed2 GROUP BY 1, 2, 3"))
def typed_relations(s: Sources) -> DataFrame:
    typed = G.with_reverse(G.typed_edges(s.edges()))
    return typed.groupBy("src_type", "relation", "dst_type").agg(F.count(F.lit(1)).alias("edges"))
