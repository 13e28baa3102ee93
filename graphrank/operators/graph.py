"""Typed node and edge tables, their validation and their statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrank.functions.columns import (
    display_label,
    gene_id,
    has_reverse,
    relation_key,
    reverse_name,
    type_name,
)
from graphrank.operators.normalize import drop_duplicates_by
from graphrank.operators.ordering import dense_index
from graphrank.schemas import (
    EDGE_ENDPOINTS,
    EDGE_KEYS,
    EDGE_PROPERTIES,
    EDGE_PROPERTY_TYPES,
    EDGE_SCHEMAS,
    EDGE_SOURCES,
    OPTIONAL_EDGE_TABLES,
)


def make_edge_table(
    rows: DataFrame,
    source_column: str,
    target_column: str,
    source_type: str,
    edge_type: str,
    target_type: str,
    source_name: str,
    properties: Sequence[str] = (),
    prefer: Sequence[Column] = (),
    unique: bool = False,
) -> DataFrame:
    """Canonical edges of one table, one per (source, target).

    ``unique`` says that the rows have no repeated pair, and saves a shuffle.
    """
    kept = [p for p in properties if p in rows.columns]
    shaped = rows.select(
        F.col(source_column).cast("string").alias("source_id"),
        F.col(target_column).cast("string").alias("target_id"),
        *kept,
    )
    if not unique:
        order = list(prefer) or ([F.desc_nulls_last("score")] if "score" in kept else [])
        shaped = drop_duplicates_by(shaped, ["source_id", "target_id"], order)
    # the type columns are constants: two keys decide, and literals stay out of the shuffle
    return shaped.select(
        "source_id",
        "target_id",
        F.lit(source_type).alias("source_type"),
        F.lit(edge_type).alias("edge_type"),
        F.lit(target_type).alias("target_type"),
        F.lit(source_name).alias("source"),
        *kept,
    )


def assemble_edges(tables: dict[str, DataFrame], unique: Sequence[str] = ()) -> DataFrame:
    """All edge tables as one DataFrame with ``edge_table`` naming the relation.

    ``unique`` names the tables whose pairs are known not to repeat.
    """
    unknown = sorted(set(tables) - set(EDGE_SCHEMAS))
    if unknown:
        raise KeyError(f"no such edge table: {unknown}")
    parts = []
    for name, rows in tables.items():
        src, rel, dst = EDGE_SCHEMAS[name]
        head, tail = EDGE_ENDPOINTS[name]
        made = make_edge_table(rows, head, tail, src, rel, dst, EDGE_SOURCES[name], EDGE_PROPERTIES[name],
                               unique=name in unique)
        parts.append(
            made.select(
                F.lit(name).alias("edge_table"),
                *EDGE_KEYS,
                "source",
                *[
                    (F.col(p) if p in made.columns else F.lit(None)).cast(kind).alias(p)
                    for p, kind in EDGE_PROPERTY_TYPES.items()
                ],
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as rows, from one scan."""
    ends = F.array(
        F.struct(F.col("source_type").alias("node_type"), F.col("source_id").alias("node_id")),
        F.struct(F.col("target_type").alias("node_type"), F.col("target_id").alias("node_id")),
    )
    return edges.select(F.explode(ends).alias("_end")).select("_end.*")


def build_nodes(edges: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Distinct endpoints, labelled by an attribute label where there is one, else by id."""
    nodes = endpoints(edges).distinct()
    if attributes is None:
        return nodes.withColumn("label", F.col("node_id"))
    given = "label" in attributes.columns
    extra = attributes.withColumnRenamed("label", "_label") if given else attributes
    joined = nodes.join(extra, ["node_type", "node_id"], "left")
    label = F.coalesce("_label", "node_id") if given else F.col("node_id")
    return joined.withColumn("label", label).drop("_label")


def normalize_gene_attributes(attributes: DataFrame) -> DataFrame:
    column = "gene_id" if "gene_id" in attributes.columns else "node_id"
    keyed = (
        attributes.withColumn("node_id", gene_id(F.col(column)))
        .withColumn("node_type", F.lit("Gene"))
        .where("node_id is not null")
    )
    return drop_duplicates_by(keyed, ["node_id", "node_type"])


def _schema_table(spark: SparkSession) -> DataFrame:
    rows = [(name, *triple, name not in OPTIONAL_EDGE_TABLES) for name, triple in EDGE_SCHEMAS.items()]
    return spark.createDataFrame(
        rows, "edge_table string, want_src string, want_rel string, want_dst string, required boolean"
    )


def validate_edges(edges: DataFrame, require_all: bool = True) -> DataFrame:
    """Error rows ``(edge_table, error)``; no rows means the endpoints are as declared.

    Reduced to distinct triples per table with a map-side combine before the join.
    """
    missing_columns = [c for c in ("source_type", "edge_type", "target_type") if c not in edges.columns]
    if missing_columns:
        return edges.select("edge_table").distinct().select(
            "edge_table",
            F.explode(F.array(*[F.concat(F.lit("missing "), F.lit(c)) for c in missing_columns])).alias("error"),
        )
    seen = edges.select("edge_table", "source_type", "edge_type", "target_type").distinct()
    checked = seen.join(_schema_table(edges.sparkSession), "edge_table", "full_outer")
    same = (
        F.col("source_type").eqNullSafe(F.col("want_src"))
        & F.col("edge_type").eqNullSafe(F.col("want_rel"))
        & F.col("target_type").eqNullSafe(F.col("want_dst"))
    )
    absent = F.col("edge_type").isNull() & F.col("source_type").isNull() & F.col("target_type").isNull()
    error = (
        F.when(F.col("want_rel").isNull(), F.lit("unknown edge table"))
        .when(absent & F.col("required") & F.lit(require_all), F.lit("missing required edge table"))
        .when(~absent & ~same, F.concat(F.lit("unexpected endpoints "),
                                        F.concat_ws("-", "source_type", "edge_type", "target_type")))
    )
    return checked.select("edge_table", error.alias("error")).where("error is not null").distinct()


def assert_edges(edges: DataFrame) -> None:
    """Raise with the number of distinct errors and the first hundred; :func:`validate_edges` has all of them."""
    found = validate_edges(edges)
    errors = [f"{r.edge_table}: {r.error}" for r in found.orderBy("edge_table", "error").limit(100).collect()]
    if errors:
        raise ValueError(f"{found.count()} errors: " + "; ".join(errors))


def check_node_range(nodes: DataFrame, min_nodes: int, max_nodes: int) -> DataFrame:
    """One row: node count and whether it lies within the inclusive range."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn(
        "in_range", F.col("nodes").between(min_nodes, max_nodes)
    )


# --------------------------------------------------------------------------- statistics


def _long(name: str, counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(name).alias("metric"), "name", F.col("value").cast("double").alias("value"))


def _global_rows(node_total: DataFrame, edge_total: DataFrame) -> DataFrame:
    """Density and mean degree from two one-row tables."""
    both = node_total.select(F.col("n").cast("double").alias("n"), edge_total.select("e").scalar().alias("e"))
    density = F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    degree = F.when(F.col("n") > 0, 2.0 * F.col("e") / F.col("n")).otherwise(0.0)
    pairs = F.array(
        F.struct(F.lit("density").alias("metric"), density.alias("value")),
        F.struct(F.lit("mean_degree").alias("metric"), degree.alias("value")),
    )
    return both.select(F.explode(pairs).alias("_p")).select(
        "_p.metric", F.lit("global").alias("name"), "_p.value"
    )


def positive_links(edges: DataFrame) -> DataFrame:
    src, rel, dst = EDGE_SCHEMAS["disease_gene"]
    hit = (F.col("source_type") == src) & (F.col("edge_type") == rel) & (F.col("target_type") == dst)
    return edges.where("edge_table = 'disease_gene'").agg(F.count_if(hit).alias("positive_links"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long table ``(metric, name, value)``. Node totals count ids, whatever their type."""
    node_counts = nodes.groupBy(F.col("node_type").alias("name")).agg(F.count_distinct("node_id").alias("value"))
    edge_counts = edges.groupBy(F.col("edge_table").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    node_total = nodes.agg(F.count_distinct("node_id").alias("n"))
    edge_total = edge_counts.agg(F.sum("value").cast("double").alias("e"))
    positives = positive_links(edges).select(
        F.lit(EDGE_SOURCES["disease_gene"]).alias("name"), F.col("positive_links").alias("value")
    )
    return (
        _long("node_count", node_counts)
        .unionByName(_long("edge_count", edge_counts))
        .unionByName(_global_rows(node_total, edge_total))
        .unionByName(_long("positive_disease_gene_links", positives))
    )


def degree_distribution(edges: DataFrame) -> DataFrame:
    """Total degree per node id over all relations, largest first."""
    return degrees(edges).orderBy(F.desc("degree"), F.asc("node_id"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def known_gene_presence(nodes: DataFrame, genes: DataFrame) -> DataFrame:
    """``(gene, present)`` for every requested gene, matched on id or symbol in upper case."""
    names = [F.upper("node_id"), *([F.upper("symbol")] if "symbol" in nodes.columns else [])]
    wanted = genes.select(F.upper("gene").alias("gene")).distinct()
    present = nodes.select(F.explode(F.array(*names)).alias("gene")).where("gene is not null").distinct()
    return wanted.join(present.withColumn("present", F.lit(True)), "gene", "left").select(
        "gene", F.coalesce("present", F.lit(False)).alias("present")
    )


# --------------------------------------------------------------------------- typed graph


def typed_edges(edges: DataFrame) -> DataFrame:
    """Edges with lower-snake types and relation: ``src_type, relation, dst_type, src, dst``."""
    return edges.select(
        type_name(F.col("source_type")).alias("src_type"),
        F.lower("edge_type").alias("relation"),
        type_name(F.col("target_type")).alias("dst_type"),
        F.col("source_id").alias("src"),
        F.col("target_id").alias("dst"),
    )


def with_reverse(typed: DataFrame) -> DataFrame:
    """Typed edges and, for directed relations, their ``rev_`` twins, from one scan."""
    forward = F.struct("src_type", "relation", "dst_type", "src", "dst")
    backward = F.struct(
        F.col("dst_type").alias("src_type"),
        reverse_name(F.col("relation")).alias("relation"),
        F.col("src_type").alias("dst_type"),
        F.col("dst").alias("src"),
        F.col("src").alias("dst"),
    )
    both = F.when(has_reverse(F.col("relation")), F.array(forward, backward)).otherwise(F.array(forward))
    return typed.select(F.explode(both).alias("_e")).select("_e.*")


def relation_edges(typed: DataFrame, src_type: str, relation: str, dst_type: str) -> DataFrame:
    return typed.where(
        (F.col("src_type") == src_type) & (F.col("relation") == relation) & (F.col("dst_type") == dst_type)
    )


def typed_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statistics of the typed graph: reverse relations count, and the same id under two types is two nodes."""
    node_counts = (
        nodes.select(type_name(F.col("node_type")).alias("name"), "node_id")
        .groupBy("name")
        .agg(F.count_distinct("node_id").alias("value"))
    )
    key = relation_key(F.col("src_type"), F.col("relation"), F.col("dst_type"))
    edge_counts = (
        with_reverse(typed_edges(edges)).groupBy(key.alias("name")).agg(F.count(F.lit(1)).alias("value"))
    )
    node_total = node_counts.agg(F.sum("value").alias("n"))
    edge_total = edge_counts.agg(F.sum("value").cast("double").alias("e"))
    positive = edge_counts.where("name = 'disease__associated_with__gene'")
    return (
        _long("node_count", node_counts)
        .unionByName(_long("edge_count", edge_counts))
        .unionByName(_global_rows(node_total, edge_total))
        .unionByName(_long("positive_disease_gene_links", positive))
    )


def node_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keyed node records with the degree over forward and reverse edges, 0 for isolated nodes."""
    both = with_reverse(typed_edges(edges))
    ends = F.array(
        F.struct(F.col("src_type").alias("node_type"), F.col("src").alias("node_id")),
        F.struct(F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id")),
    )
    counted = (
        both.select(F.explode(ends).alias("_n")).select("_n.*")
        .groupBy("node_type", "node_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    typed = nodes.withColumn("node_type", type_name(F.col("node_type")))
    return typed.join(counted, ["node_type", "node_id"], "left").select(
        F.concat_ws(":", "node_type", "node_id").alias("id"),
        "node_type",
        "node_id",
        display_label(typed).alias("label"),
        F.coalesce("degree", F.lit(0)).alias("degree"),
    )


def edge_records(edges: DataFrame) -> DataFrame:
    """Keyed edge records of the typed graph, reverse relations included."""
    source = F.concat_ws(":", "src_type", "src")
    target = F.concat_ws(":", "dst_type", "dst")
    key = relation_key(F.col("src_type"), F.col("relation"), F.col("dst_type"))
    return with_reverse(typed_edges(edges)).select(
        F.concat(key, F.lit(":"), source, F.lit(">"), target).alias("id"),
        source.alias("source"),
        target.alias("target"),
        key.alias("edge_type"),
        "relation",
    )


def node_index(nodes: DataFrame) -> DataFrame:
    """0-based index per node type in id order."""
    unique = nodes.select(type_name(F.col("node_type")).alias("node_type"), "node_id").distinct()
    return dense_index(unique, ["node_type"], [F.col("node_id")], "node_idx")


def edge_index(typed: DataFrame, index: DataFrame) -> DataFrame:
    """Edges as index pairs; edges with an unknown end are dropped."""
    heads = index.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src"),
                         F.col("node_idx").alias("src_idx"))
    tails = index.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst"),
                         F.col("node_idx").alias("dst_idx"))
    return typed.join(heads, ["src_type", "src"]).join(tails, ["dst_type", "dst"]).select(
        "src_type", "relation", "dst_type", "src_idx", "dst_idx"
    )


def neighbours(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct undirected neighbours ``(node, neighbour)``."""
    return _both_ways(pairs, src, dst).distinct()


def undirected_degrees(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected degree; a self-loop counts two."""
    return (
        pairs.select(F.explode(F.array(src, dst)).alias("node"))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def _both_ways(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    ways = F.array(
        F.struct(F.col(src).alias("node"), F.col(dst).alias("neighbour")),
        F.struct(F.col(dst).alias("node"), F.col(src).alias("neighbour")),
    )
    return pairs.select(F.explode(ways).alias("_w")).select("_w.*")


def unique_key_violations(nodes: DataFrame) -> DataFrame:
    """Node keys that occur more than once; empty when the key is unique per label."""
    return (
        nodes.groupBy("node_type", "node_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
