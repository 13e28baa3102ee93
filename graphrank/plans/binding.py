"""Binding of the test tables to the source tables of the typed graph.

Each source is derived from the relational tables by scans, equi-joins and
aggregations, so it grows with them. Customers stand for diseases, parts for
genes, suppliers for leaf pathways (under nations, under regions), orders for
drugs and part sizes for annotation terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrank.operators import graph, normalize
from graphrank.plans.lineage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gene_key(number: Column) -> Column:
    return F.concat(F.lit("ENSG"), F.lpad(number.cast("string"), 11, "0"))


def go_key(number: Column) -> Column:
    return F.concat(F.lit("GO:"), F.lpad(number.cast("string"), 7, "0"))


class Sources:
    """Raw source tables, with versioned and multi-valued ids as real files have them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def associations(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "l_partkey")
            .agg(F.sum("l_quantity").alias("score"))
            .select(
                F.concat(F.lit("C"), "o_custkey").alias("diseaseId"),
                gene_key(F.col("l_partkey")).alias("targetId"),
                F.col("score").cast("double").alias("score"),
            )
        )

    def accession_file(self) -> DataFrame:
        """Accession to gene, one or two versioned genes per field."""
        number = F.col("p_partkey")
        first = F.concat(gene_key(number), F.lit("."), (F.col("p_size") % 9).cast("string"))
        field = F.when(F.col("p_size") % 5 == 0, F.concat(first, F.lit("; "), gene_key(number + 1), F.lit(",")))
        return self.table("part").select(
            F.concat(F.lit("P"), number).alias("From"), F.coalesce(field, first).alias("To")
        )

    def protein_file(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("9606.ENSP"), F.col("p_partkey")).alias("protein_external_id"),
            F.concat(gene_key(F.col("p_partkey")), F.lit(".1")).alias("ensembl_gene_id"),
        )

    def target_file(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("CHEMBL_T"), F.col("p_partkey")).alias("target_chembl_id"),
            F.concat(F.lit("P"), F.col("p_partkey")).alias("uniprot_id"),
        )

    def protein_links(self) -> DataFrame:
        """Part of a line and lead part of its supplier; score from the quantity they share."""
        return (
            self.table("lineitem")
            .groupBy("l_partkey", "l_suppkey")
            .agg(F.sum("l_quantity").alias("_qty"))
            .select(
                F.concat(F.lit("9606.ENSP"), F.col("l_partkey")).alias("protein1"),
                F.concat(F.lit("9606.ENSP"), F.col("l_suppkey") * 20).alias("protein2"),
                (20.0 * F.col("_qty")).alias("combined_score"),
            )
        )

    def pathway_file(self) -> DataFrame:
        return self.table("lineitem").select("l_partkey", "l_suppkey").distinct().select(
            F.concat(gene_key(F.col("l_partkey")), F.lit(".2")).alias("gene_id"),
            F.concat(F.lit("R-HSA-S"), F.col("l_suppkey")).alias("pathway_id"),
            F.concat(F.lit("pathway of supplier "), F.col("l_suppkey")).alias("pathway_name"),
            F.lit("Homo sapiens").alias("species"),
        )

    def hierarchy_file(self) -> DataFrame:
        nations = self.table("nation").select(
            F.concat(F.lit("R-HSA-R"), "n_regionkey").alias("parent"),
            F.concat(F.lit("R-HSA-N"), "n_nationkey").alias("child"),
        )
        leaves = self.table("supplier").select(
            F.concat(F.lit("R-HSA-N"), "s_nationkey").alias("parent"),
            F.concat(F.lit("R-HSA-S"), "s_suppkey").alias("child"),
        )
        return nations.unionByName(leaves)

    def mechanism_file(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat(F.lit("CHEMBL"), "l_orderkey").alias("molecule_chembl_id"),
            F.concat(F.lit("CHEMBL_T"), "l_partkey").alias("target_chembl_id"),
            F.col("l_returnflag").alias("action_type"),
            F.concat_ws(" ", F.lit("line status"), "l_linestatus").alias("mechanism_of_action"),
        )

    def annotation_file(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("P"), "p_partkey").alias("db_object_id"),
            go_key(F.col("p_size")).alias("go_id"),
            F.col("p_brand").alias("evidence_code"),
        )

    # ----------------------------------------------------------------- normalised tables

    def accessions(self) -> DataFrame:
        return normalize.map_accessions(self.accession_file())

    def targets(self) -> DataFrame:
        return normalize.map_targets(self.target_file(), self.accessions())

    def disease_gene(self) -> DataFrame:
        return normalize.disease_genes(self.associations(), disease=None)

    def gene_gene(self) -> DataFrame:
        confident = normalize.confident_links(self.protein_links())
        return normalize.links_to_genes(confident, normalize.map_proteins(self.protein_file()))

    def gene_pathway(self) -> DataFrame:
        return normalize.gene_pathways(self.pathway_file())

    def pathway_pathway(self) -> DataFrame:
        return normalize.pathway_hierarchy(self.hierarchy_file())

    def drug_gene(self) -> DataFrame:
        return normalize.drug_targets(self.mechanism_file(), self.targets())

    def gene_go(self) -> DataFrame:
        return normalize.gene_annotations(self.annotation_file(), self.accessions())

    def tables(self) -> dict[str, DataFrame]:
        return {
            "disease_gene": self.disease_gene(),
            "gene_gene": self.gene_gene(),
            "gene_pathway": self.gene_pathway(),
            "drug_gene": self.drug_gene(),
            "gene_go": self.gene_go(),
            "pathway_pathway": self.pathway_pathway(),
        }

    def edges(self, *names: str) -> DataFrame:
        """Canonical edges of the named tables (all without names)."""
        makers = {
            "disease_gene": self.disease_gene,
            "gene_gene": self.gene_gene,
            "gene_pathway": self.gene_pathway,
            "drug_gene": self.drug_gene,
            "gene_go": self.gene_go,
            "pathway_pathway": self.pathway_pathway,
        }
        return graph.assemble_edges({n: makers[n]() for n in (names or makers)}, normalize.UNIQUE_PAIRS)

    def stored_edges(self, *names: str) -> DataFrame:
        """Edges stored once, for jobs that read them several times."""
        return materialize(self.edges(*names))

    def gene_attributes(self) -> DataFrame:
        return self.table("part").select(
            gene_key(F.col("p_partkey")).alias("gene_id"), F.upper("p_name").alias("symbol")
        )

    def node_attributes(self) -> DataFrame:
        """Attributes of genes and diseases, in the shape of the node table."""
        genes = graph.normalize_gene_attributes(self.gene_attributes()).select(
            "node_type", "node_id", "symbol", F.lit(None).cast("string").alias("label")
        )
        diseases = self.table("customer").select(
            F.lit("Disease").alias("node_type"),
            F.concat(F.lit("C"), "c_custkey").alias("node_id"),
            F.lit(None).cast("string").alias("symbol"),
            F.col("c_name").alias("label"),
        )
        return genes.unionByName(diseases)

    def nodes(self, edges: DataFrame | None = None) -> DataFrame:
        return graph.build_nodes(self.edges() if edges is None else edges, self.node_attributes())
