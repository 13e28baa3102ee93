"""Queries over sources, scalar functions and identifier mapping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrank.catalog.registry import query
from graphrank.catalog.sql import gene, with_tables
from graphrank.functions import columns as C
from graphrank.functions import vectors as V
from graphrank.operators import normalize as N
from graphrank.plans.binding import Sources, gene_key, go_key
from graphrank.plans.lineage import ensure_checkpoint_dir
from graphrank.sources import tables as T


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, on storage all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- scalar functions


@query("C4, C1", f"""SELECT p_partkey, {gene('p_partkey')} AS gene_id FROM part WHERE p_size % 3 <> 0
    UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 = 0""")
def normalized_gene_ids(s: Sources) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("ENSP"), "p_partkey")).otherwise(
        F.concat(F.lit("id="), gene_key(F.col("p_partkey")), F.lit(".12"))
    )
    return s.table("part").select("p_partkey", C.gene_id(raw).alias("gene_id"))


@query("C5", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS token FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 's' || l_suppkey FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem""")
def split_identifiers(s: Sources) -> DataFrame:
    text = F.concat(F.col("l_partkey").cast("string"), F.lit("; s"), F.col("l_suppkey"), F.lit(" ,| "), "l_returnflag", F.lit("|"))
    return s.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.explode(C.identifiers(text)).alias("token")
    )


@query("C6, C7", """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.0 ELSE c_acctbal END AS amount FROM customer""")
def coerced_numbers(s: Sources) -> DataFrame:
    text = F.when(F.col("c_mktsegment") == "MACHINERY", "unknown").otherwise(F.col("c_acctbal").cast("string"))
    return s.table("customer").select("c_custkey", C.numeric(text).alias("amount"))


@query("C8", """SELECT event_id, CASE event_type WHEN 'click' THEN 'MF' WHEN 'error' THEN 'CC' ELSE 'BP' END AS namespace FROM events""")
def annotation_namespaces(s: Sources) -> DataFrame:
    raw = F.when(F.col("event_type") == "click", "Molecular_Function").when(F.col("event_type") == "error", "C")
    return s.table("events").select("event_id", C.go_namespace(raw).alias("namespace"))


@query("C9", """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS idx, unnest(embedding) AS value FROM embeddings""")
def parsed_vectors(s: Sources) -> DataFrame:
    """Every component of every vector, read from text."""
    comma = F.concat(F.lit("["), F.concat_ws(", ", F.col("embedding").cast("array<string>")), F.lit("]"))
    blank = F.concat_ws(" ", F.col("embedding").cast("array<string>"))
    vector = C.parse_vector(F.when(F.col("vec_id") % 2 == 0, comma).otherwise(blank))
    return s.table("embeddings").select("vec_id", F.posexplode(vector).alias("idx", "value")).select(
        "vec_id", F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("float").alias("value"))


@query("C2, C3, C7", """SELECT p_partkey, p_size % 5 = 0 AS name_missing, p_size % 7 = 0 AS price_missing FROM part""")
def missing_values(s: Sources) -> DataFrame:
    """Columns found by the first of several names, and what is missing in them."""
    parts = s.table("part")
    C.ensure_columns(parts, ["p_partkey", "p_size"])
    name, price = C.optional_column(parts, ("symbol", "label", "p_name")), C.first_present_column(parts, ("price", "p_retailprice"))
    text = F.when(F.col("p_size") % 5 != 0, F.col(name))
    number = F.when(F.col("p_size") % 7 == 0, float("nan")).otherwise(F.col(price))
    return parts.select("p_partkey", C.is_missing(text).alias("name_missing"), C.is_missing(number, floating=True).alias("price_missing"))


_HASHED = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(replace(lower(text), '_', ' '),
        '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) AS word FROM documents),
    h AS (SELECT doc_id, sha256(word) AS d FROM w),
    p AS (SELECT doc_id, CAST(CAST('0x' || substr(d, 1, 16) AS UBIGINT) % 64 AS BIGINT) AS idx,
        CASE WHEN CAST('0x' || substr(d, 17, 2) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END AS s FROM h),
    c AS (SELECT doc_id, idx, sum(s) AS v FROM p GROUP BY 1, 2),
    l AS (SELECT doc_id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS len FROM c GROUP BY 1)"""


@query("C10", f"WITH {_HASHED} SELECT doc_id, idx, round(v / len, 6) AS value FROM c JOIN l USING (doc_id) WHERE v <> 0")
def hashed_text_components(s: Sources) -> DataFrame:
    return V.hashed_components(s.table("documents"), "doc_id", F.col("text"), 64).select(
        "doc_id", "idx", F.round("value", 6).alias("value")
    )


@query("C11, F7", """SELECT p_partkey, CAST(CAST('0x' || substr(sha256(salt || ':' || p_name || ' ' || p_type), 1, 16) AS UBIGINT) % 2048 AS BIGINT) AS bit
    FROM part, (SELECT unnest(range(32)) AS salt) GROUP BY ALL""")
def fingerprint_bits(s: Sources) -> DataFrame:
    bits = C.fingerprint_bits(F.concat_ws(" ", "p_name", "p_type"))
    return s.table("part").select("p_partkey", F.explode(bits).alias("bit"))


@query("C12, C13, C15", """SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine,
    round(1 / (1 + exp(-10 * list_dot_product(a.e, b.e))), 6) AS probability,
    round(abs(a.e[1] - b.e[1]), 6) AS first_gap, round(a.e[64] * b.e[64], 6) AS last_product
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def vector_pairs(s: Sources) -> DataFrame:
    rows = s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = rows.join(nxt, "vec_id")
    pair = V.pair_features(F.col("a"), F.col("b"))
    return both.select(
        "vec_id",
        F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"),
        F.round(C.sigmoid(10.0 * V.dot(F.col("a"), F.col("b"))), 6).alias("probability"),
        F.round(pair[128], 6).alias("first_gap"),
        F.round(pair[255], 6).alias("last_product"),
    )


@query("C17", """SELECT DISTINCT p_name AS name FROM part WHERE NOT regexp_full_match(p_name, '[A-Za-z][A-Za-z0-9_]*')""")
def unsafe_names(s: Sources) -> DataFrame:
    return C.unsafe_names(s.table("part").select(F.col("p_name").alias("name")), "name")


# --------------------------------------------------------------------------- sources and sinks


@query("S2, S4, C18, R17", f"""SELECT {gene('p_partkey')} AS gene_id, 'GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS go_id, p_brand AS evidence_code FROM part""")
def annotation_file_round_trip(s: Sources) -> DataFrame:
    """Write the 17-column annotation file, read it back and normalise it."""
    folder = scratch(s.spark, "annotations")
    wanted = {
        "db_object_id": F.concat(F.lit("P"), F.col("p_partkey")),
        "go_id": go_key(F.col("p_size")),
        "evidence_code": F.col("p_brand"),
    }
    rows = s.table("part").select(*[wanted.get(f.name, F.lit("x")).cast("string").alias(f.name) for f in T.GAF.fields])
    rows.write.option("sep", "\t").csv(folder)
    hub = s.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("source_id"),
                                 gene_key(F.col("p_partkey")).alias("ensembl_gene_id"))
    return N.gene_annotations(T.read_gaf(s.spark, folder), hub).select("gene_id", "go_id", "evidence_code")


@query("S3, S1, R14", with_tables("gp", """SELECT head AS gene_id, tail AS pathway_id, 'pathway of supplier ' || substr(tail, 8) AS pathway_name FROM gp"""))
def pathway_file_round_trip(s: Sources) -> DataFrame:
    folder = scratch(s.spark, "pathways")
    s.pathway_file().select(
        "gene_id", "pathway_id", F.lit("url").alias("url"), "pathway_name", F.lit("IEA").alias("evidence"), "species"
    ).write.option("sep", "\t").csv(folder)
    return N.gene_pathways(T.read_gene_pathways(s.spark, folder)).select("gene_id", "pathway_id", "pathway_name")


@query("S1, S4", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def text_table_round_trip(s: Sources) -> DataFrame:
    folder = scratch(s.spark, "customers") + ".tsv"
    T.write_table(s.table("customer").select("c_custkey", "c_name", "c_acctbal"), folder)
    return T.read_table(s.spark, folder, "c_custkey bigint, c_name string, c_acctbal double")


_CACHE_ORACLE = f"""WITH {_HASHED},
    v AS (SELECT d.doc_id, coalesce(c.v / l.len, 0.0) AS x FROM documents d JOIN l USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id AND c.idx = 0)
    SELECT doc_id AS id, 'cache' AS origin, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM documents JOIN embeddings ON vec_id = doc_id
    UNION ALL SELECT doc_id, 'computed', round(x, 6) FROM v WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""


@query("S10", _CACHE_ORACLE)
def cached_embeddings(s: Sources) -> DataFrame:
    wanted = s.table("documents").select(F.col("doc_id").alias("id"), "text")
    cached = s.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    out = T.read_through_cache(wanted, cached, lambda rows: V.hashed_vectors(rows, "id", F.col("text"), 64))
    return out.select("id", "origin", F.round(F.col("vector")[0], 6).alias("first_value"))


@query("S14", """SELECT event_id, lower(event_type) AS edge_type, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS absent FROM events""")
def flattened_properties(s: Sources) -> DataFrame:
    rows = s.table("events").select(
        "event_id", F.upper("event_type").alias("edge_type"),
        F.from_json("props", "map<string,string>").alias("properties"),
    )
    return T.flatten_properties(rows, ["event_id", "edge_type"], {"k": "bigint", "absent": "double"})


# --------------------------------------------------------------------------- identifier mapping


_ACC = "SELECT 'UniProt' AS source_namespace, 'P' || k AS source_id, g AS ensembl_gene_id FROM acc"
_PROT = f"SELECT 'STRING' AS source_namespace, '9606.ENSP' || p_partkey AS source_id, {gene('p_partkey')} AS ensembl_gene_id FROM part"
_TARG = "SELECT 'ChEMBL' AS source_namespace, 'CHEMBL_T' || k AS source_id, g AS ensembl_gene_id FROM acc"


@query("R2, C1", _PROT)
def protein_mapping(s: Sources) -> DataFrame:
    return N.map_proteins(s.protein_file())


@query("R3, R19, C5", with_tables("acc", _ACC))
def accession_mapping(s: Sources) -> DataFrame:
    return N.map_accessions(s.accession_file())


@query("R4", with_tables("acc", _TARG))
def target_mapping(s: Sources) -> DataFrame:
    return s.targets()


@query("R7", with_tables("acc", f"{_ACC} UNION {_PROT} UNION {_TARG}"))
def combined_mapping(s: Sources) -> DataFrame:
    return N.combine(s.accessions(), N.map_proteins(s.protein_file()), s.targets(), s.accessions())


_SEEDS = f"(SELECT DISTINCT {gene('l_partkey')} AS g FROM lineitem WHERE l_quantity >= 45)"
_MAPPED = f"(SELECT {gene('p_partkey')} AS g FROM part WHERE p_size < 48)"


def _seed_frames(s: Sources) -> tuple[DataFrame, DataFrame]:
    seeds = s.table("lineitem").where("l_quantity >= 45").select(
        F.concat(gene_key(F.col("l_partkey")), F.lit(".3")).alias("ensembl_gene_id")
    )
    mapped = s.table("part").where("p_size < 48").select(gene_key(F.col("p_partkey")).alias("ensembl_gene_id"))
    return seeds, mapped


@query("R5", f"""SELECT count(*) AS seed_gene_count, count(m.g) AS mapped_seed_gene_count, round(count(m.g) / count(*), 6) AS coverage,
    CAST(0.9 AS DOUBLE) AS required_coverage, count(m.g) / count(*) > 0.9 AS passes FROM {_SEEDS} s LEFT JOIN {_MAPPED} m USING (g)""")
def seed_coverage(s: Sources) -> DataFrame:
    return N.coverage_report(*_seed_frames(s)).withColumn("coverage", F.round("coverage", 6))


@query("R6", f"SELECT s.g AS ensembl_gene_id, 'missing_from_crosswalk' AS reason FROM {_SEEDS} s ANTI JOIN {_MAPPED} m USING (g)")
def unmapped_seeds(s: Sources) -> DataFrame:
    return N.unmapped_genes(*_seed_frames(s))


# --------------------------------------------------------------------------- edge sources


@query("R8, R1", with_tables("dg", "SELECT head AS disease_id, tail AS gene_id, score FROM dg WHERE score >= 20"))
def disease_gene_edges(s: Sources) -> DataFrame:
    return N.disease_genes(s.associations(), None, 20.0).select("disease_id", "gene_id", "score")


@query("R8, R20", with_tables("dg", """SELECT 'C42' AS disease_id, count(DISTINCT tail) AS target_count FROM dg WHERE head = 'C42'"""))
def disease_target_count(s: Sources) -> DataFrame:
    return N.associated_target_count(s.associations(), "C42")


@query("R9", with_tables("dg", """SELECT tail AS gene_id, max(score) AS score FROM dg GROUP BY tail ORDER BY score DESC, gene_id LIMIT 100"""))
def seed_genes(s: Sources) -> DataFrame:
    return N.seed_genes(s.disease_gene(), 100)


@query("R10", with_tables("pl", "SELECT a AS string_protein_a, b AS string_protein_b, score FROM pl WHERE score >= 700"))
def confident_protein_links(s: Sources) -> DataFrame:
    return N.confident_links(s.protein_links())


@query("R11", with_tables("gg", "SELECT head AS gene_a, tail AS gene_b, score FROM gg"))
def mapped_gene_links(s: Sources) -> DataFrame:
    return s.gene_gene()


@query("R12", with_tables("gg", "SELECT head AS gene_a, tail AS gene_b, score FROM gg WHERE score >= 800"))
def direct_gene_links(s: Sources) -> DataFrame:
    raw = s.protein_links().select(
        gene_key(F.regexp_extract("protein1", "([0-9]+)$", 1)).alias("gene_a"),
        gene_key(F.regexp_extract("protein2", "([0-9]+)$", 1)).alias("gene_b"),
        F.col("combined_score").cast("string").alias("score"),
    )
    return N.gene_links(raw, 800)


# independent restatement of the cap: cumulative number of genes over the links, best first
_HOP = """seeds AS (SELECT tail AS g FROM dg GROUP BY tail ORDER BY max(score) DESC, tail LIMIT 50),
    touch AS (SELECT head, tail, score, CASE WHEN head NOT IN (SELECT g FROM seeds) THEN head WHEN tail NOT IN (SELECT g FROM seeds) THEN tail END AS fresh
        FROM gg WHERE head IN (SELECT g FROM seeds) OR tail IN (SELECT g FROM seeds)),
    best AS (SELECT fresh, row_number() OVER (ORDER BY score DESC, head, tail) AS r FROM (
        SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY score DESC, head, tail) AS k FROM touch WHERE fresh IS NOT NULL) WHERE k = 1)"""


@query("R13", with_tables("dg gg", """SELECT head AS gene_a, tail AS gene_b, score FROM touch
    WHERE fresh IS NULL OR fresh IN (SELECT fresh FROM best WHERE r <= 150)""", _HOP))
def capped_expansion(s: Sources) -> DataFrame:
    return N.expand_one_hop(N.seed_genes(s.disease_gene(), 50), s.gene_gene(), 200)


@query("R13", with_tables("dg gg", "SELECT head AS gene_a, tail AS gene_b, score FROM touch", _HOP))
def open_expansion(s: Sources) -> DataFrame:
    return N.expand_one_hop(N.seed_genes(s.disease_gene(), 50), s.gene_gene())


@query("R14, C18", with_tables("gp", "SELECT head AS gene_id, tail AS pathway_id, 'pathway of supplier ' || substr(tail, 8) AS pathway_name FROM gp"))
def gene_pathway_edges(s: Sources) -> DataFrame:
    return s.gene_pathway().select("gene_id", "pathway_id", "pathway_name")


@query("R15", with_tables("pp", "SELECT head AS parent_pathway_id, tail AS child_pathway_id FROM pp"))
def pathway_hierarchy_edges(s: Sources) -> DataFrame:
    return s.pathway_pathway().select("parent_pathway_id", "child_pathway_id")


@query("R16, R4", with_tables("dr", """SELECT head AS drug_id, tail AS gene_id, target AS target_chembl_id, split_part(min(action || '|' || mechanism), '|', 1) AS action_type,
    split_part(min(action || '|' || mechanism), '|', 2) AS mechanism_of_action FROM dr GROUP BY 1, 2, 3"""))
def drug_gene_edges(s: Sources) -> DataFrame:
    return s.drug_gene().drop("source")


@query("R17", with_tables("go", "SELECT head AS gene_id, tail AS go_id, evidence AS evidence_code FROM go"))
def gene_annotation_edges(s: Sources) -> DataFrame:
    return s.gene_go().drop("source")


@query("R18", with_tables("acc", """SELECT DISTINCT g AS gene_id, 'GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS go_id, p_brand AS evidence_code, p_type AS source
    FROM part JOIN acc ON p_partkey = k"""))
def accession_annotation_edges(s: Sources) -> DataFrame:
    rows = s.table("part").select(
        F.concat(F.lit("P"), "p_partkey").alias("uniprot_id"), go_key(F.col("p_size")).alias("go_id"),
        F.col("p_brand").alias("evidence_code"), F.col("p_type").alias("source"),
    )
    return N.accession_annotations(rows, s.accessions())


@query("§7.6 caps", with_tables("go", """SELECT head AS gene_id, tail AS go_id FROM go WHERE tail IN (SELECT tail FROM go GROUP BY tail ORDER BY count(*) DESC, tail LIMIT 10)"""))
def largest_terms(s: Sources) -> DataFrame:
    return N.keep_largest(s.gene_go(), "go_id", 10).select("gene_id", "go_id")
