"""Source tables to identifier hub and normalised edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphrank.functions.columns import (
    first_present_column,
    gene_id,
    identifiers,
    numeric,
    optional_column,
)
from graphrank.operators.ordering import first_per_key, top_per_key
from graphrank.plans.lineage import materialize

# --- fixed values: column names under which sources carry each field, in the order tried
PROTEIN_COLUMNS = ("string_protein_id", "protein_external_id", "protein", "protein1", "string_id")
ACCESSION_COLUMNS = ("uniprot_id", "UniProtKB-AC", "From", "Entry", "accession")
GENE_COLUMNS = ("ensembl_gene_id", "Ensembl", "To", "Gene stable ID", "gene_id")
TARGET_COLUMNS = ("target_chembl_id", "target_id", "chembl_target_id")
DISEASE_COLUMNS = ("disease_id", "diseaseId", "disease")
ASSOCIATED_GENE_COLUMNS = ("target_id", "targetId", "gene_id", "target")
ASSOCIATION_SCORE_COLUMNS = ("score", "association_score", "overall_score")
DEFAULT_DISEASE = "EFO_0004616"
DEFAULT_SPECIES = "Homo sapiens"
UNMAPPED_REASON = "missing_from_crosswalk"

# edge tables whose normalised rows are unique per pair (a drug may reach a gene by several targets)
UNIQUE_PAIRS = ("disease_gene", "gene_gene", "gene_pathway", "gene_go", "pathway_pathway")

_CROSSWALK = ["source_namespace", "source_id", "ensembl_gene_id"]


def drop_duplicates_by(df: DataFrame, keys: Sequence[str], prefer: Sequence[Column] = ()) -> DataFrame:
    """One row per key. ``prefer`` orders the candidates; remaining columns break ties.

    Files have no row order in Spark, so "the first row" is defined by values.
    """
    rest = [name for name in df.columns if name not in keys]
    if not rest and not prefer:
        return df.distinct()
    if prefer:
        return first_per_key(df, keys, [*prefer, *[F.col(name).asc_nulls_last() for name in rest]])
    # the least of the remaining columns, nulls last: rows are sorted by key at most, and not at all where they already are
    least = F.min(F.struct(*[c for name in rest for c in (F.col(name).isNull().alias(f"_no_{name}"), F.col(name))]))
    return df.groupBy(*keys).agg(least.alias("_least")).select(
        *[F.col(name) if name in keys else F.col("_least")[name].alias(name) for name in df.columns]
    )


def best_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its best score: a hash aggregate with map-side combine, no sort."""
    return df.groupBy(*keys).agg(F.max("score").alias("score"))


# --------------------------------------------------------------------------- identifier hub


def map_proteins(info: DataFrame, id_column: str | None = None, gene_column: str | None = None) -> DataFrame:
    source = id_column or first_present_column(info, PROTEIN_COLUMNS)
    target = gene_column or first_present_column(info, GENE_COLUMNS)
    return (
        info.select(
            F.lit("STRING").alias("source_namespace"),
            F.col(source).cast("string").alias("source_id"),
            gene_id(F.col(target)).alias("ensembl_gene_id"),
        )
        .where("ensembl_gene_id is not null")
        .distinct()
    )


def map_accessions(mapping: DataFrame, id_column: str | None = None, gene_column: str | None = None) -> DataFrame:
    """One row per accession and gene; a field may hold several genes."""
    source = id_column or first_present_column(mapping, ACCESSION_COLUMNS)
    target = gene_column or first_present_column(mapping, GENE_COLUMNS)
    return (
        mapping.select(
            F.lit("UniProt").alias("source_namespace"),
            F.col(source).cast("string").alias("source_id"),
            F.explode(identifiers(F.col(target))).alias("_token"),
        )
        .select("source_namespace", "source_id", gene_id(F.col("_token")).alias("ensembl_gene_id"))
        .where("ensembl_gene_id is not null")
        .distinct()
    )


def map_targets(targets: DataFrame, accessions: DataFrame, id_column: str | None = None,
                accession_column: str | None = None) -> DataFrame:
    """Drug targets to genes through their accession. A target may reach several genes."""
    target = id_column or first_present_column(targets, TARGET_COLUMNS)
    accession = accession_column or first_present_column(targets, ACCESSION_COLUMNS)
    hub = accessions.select(F.col("source_id").alias("_acc"), "ensembl_gene_id")
    return (
        targets.select(F.col(target).cast("string").alias("source_id"), F.col(accession).alias("_acc"))
        .distinct()
        .join(hub, "_acc")
        .select(F.lit("ChEMBL").alias("source_namespace"), "source_id", "ensembl_gene_id")
        .where("ensembl_gene_id is not null")
        .distinct()
    )


def combine(*maps: DataFrame) -> DataFrame:
    """All mappings as one crosswalk; an empty one without mappings."""
    if not maps:
        return SparkSession.active().createDataFrame([], ", ".join(f"{c} string" for c in _CROSSWALK))
    union = reduce(lambda a, b: a.unionByName(b), [m.select(*_CROSSWALK) for m in maps])
    return union.dropna(subset=["source_id", "ensembl_gene_id"]).distinct()


def _coverage_flags(seeds: DataFrame, mapped: DataFrame) -> DataFrame:
    wanted = seeds.select(gene_id(F.col("ensembl_gene_id")).alias("gene")).where("gene is not null").distinct()
    known = mapped.select(gene_id(F.col("ensembl_gene_id")).alias("gene")).where("gene is not null").distinct()
    return wanted.join(known.withColumn("mapped", F.lit(True)), "gene", "left").select(
        "gene", F.coalesce("mapped", F.lit(False)).alias("mapped")
    )


def coverage_report(seeds: DataFrame, mapped: DataFrame, required: float = 0.90) -> DataFrame:
    """One row: seed genes, mapped seed genes, coverage, and whether it is strictly above ``required``."""
    counts = _coverage_flags(seeds, mapped).agg(
        F.count(F.lit(1)).alias("seed_gene_count"), F.count_if("mapped").alias("mapped_seed_gene_count")
    )
    coverage = F.when(
        F.col("seed_gene_count") > 0, F.col("mapped_seed_gene_count") / F.col("seed_gene_count")
    ).otherwise(0.0)
    return counts.withColumn("coverage", coverage).select(
        "*",
        F.lit(float(required)).alias("required_coverage"),
        (F.col("coverage") > required).alias("passes"),
    )


def unmapped_genes(seeds: DataFrame, mapped: DataFrame) -> DataFrame:
    """Seed genes without a mapping, one row each with the reason (a table, not a list on one row)."""
    return _coverage_flags(seeds, mapped).where(~F.col("mapped")).select(
        F.col("gene").alias("ensembl_gene_id"), F.lit(UNMAPPED_REASON).alias("reason")
    )


# --------------------------------------------------------------------------- edge sources


def disease_genes(associations: DataFrame, disease: str | None = DEFAULT_DISEASE, min_score: float = 0.0) -> DataFrame:
    """Associations of one disease (``None``: of all) at or above ``min_score``.

    The disease filter stands on the raw column, so it reaches the scan.
    """
    disease_column = first_present_column(associations, DISEASE_COLUMNS)
    gene_column = first_present_column(associations, ASSOCIATED_GENE_COLUMNS)
    score_column = first_present_column(associations, ASSOCIATION_SCORE_COLUMNS)
    rows = associations if disease is None else associations.where(F.col(disease_column) == disease)
    shaped = rows.select(
        F.col(disease_column).cast("string").alias("disease_id"),
        gene_id(F.col(gene_column)).alias("gene_id"),
        numeric(F.col(score_column)).alias("score"),
    ).where((F.col("gene_id").isNotNull()) & (F.col("score") >= min_score))
    return best_score(shaped, ["disease_id", "gene_id"]).withColumn("source", F.lit("Open Targets"))


def seed_genes(associations: DataFrame, max_genes: int | None = None) -> DataFrame:
    """Genes by best association score, best first. Aggregated before the sort."""
    best = associations.groupBy("gene_id").agg(F.max("score").alias("score"))
    ordered = best.orderBy(F.desc("score"), F.asc("gene_id"))
    return ordered if max_genes is None else ordered.limit(max_genes)


def associated_target_count(associations: DataFrame, disease: str) -> DataFrame:
    column = first_present_column(associations, DISEASE_COLUMNS)
    gene = first_present_column(associations, ASSOCIATED_GENE_COLUMNS)
    return (
        associations.where(F.col(column) == disease)
        .agg(F.count_distinct(F.col(gene)).alias("target_count"))
        .select(F.lit(disease).alias("disease_id"), "target_count")
    )


def confident_links(links: DataFrame, threshold: float = 700) -> DataFrame:
    """Protein links at or above the threshold; (a, b) and (b, a) stay two links."""
    a = first_present_column(links, ("protein1", "source_id", "gene_a"))
    b = first_present_column(links, ("protein2", "target_id", "gene_b"))
    score = first_present_column(links, ("combined_score", "score"))
    shaped = links.select(
        F.col(a).cast("string").alias("string_protein_a"),
        F.col(b).cast("string").alias("string_protein_b"),
        numeric(F.col(score)).alias("score"),
    ).where(F.col("score") >= threshold)
    return best_score(shaped, ["string_protein_a", "string_protein_b"])


def links_to_genes(links: DataFrame, proteins: DataFrame) -> DataFrame:
    """Protein links as gene links. Inner joins: unmapped ends would be dropped anyway."""
    hub = proteins.select("source_id", "ensembl_gene_id").where("ensembl_gene_id is not null")
    left = hub.select(F.col("source_id").alias("string_protein_a"), F.col("ensembl_gene_id").alias("gene_a"))
    right = hub.select(F.col("source_id").alias("string_protein_b"), F.col("ensembl_gene_id").alias("gene_b"))
    mapped = (
        links.join(left, "string_protein_a")
        .join(right, "string_protein_b")
        .where("gene_a <> gene_b")
        .select("gene_a", "gene_b", "score")
    )
    return best_score(mapped, ["gene_a", "gene_b"])


def gene_links(links: DataFrame, threshold: float = 700) -> DataFrame:
    """Links that are keyed by gene already."""
    a = first_present_column(links, ("gene_a", "source_id", "protein1"))
    b = first_present_column(links, ("gene_b", "target_id", "protein2"))
    score = first_present_column(links, ("score", "combined_score"))
    shaped = links.select(
        gene_id(F.col(a)).alias("gene_a"), gene_id(F.col(b)).alias("gene_b"), numeric(F.col(score)).alias("score")
    ).where((F.col("score") >= threshold) & (F.col("gene_a") != F.col("gene_b")))
    return best_score(shaped, ["gene_a", "gene_b"])


def expand_one_hop(seeds: DataFrame, links: DataFrame, max_total_genes: int | None = None) -> DataFrame:
    """Links that touch a seed gene, with an optional cap on seeds plus new genes.

    Walking the links from best to worst and accepting a link while the gene
    set stays within the cap admits exactly the first ``cap - seeds`` new genes
    by their best link, because a link at a seed brings at most one new gene.
    So the cap is one aggregation and one top-n.
    """
    # each is read several times below
    seed = materialize(seeds.select(F.col("gene_id").alias("_seed")).where("_seed is not null").distinct())
    marked = materialize(
        links.join(seed.select("_seed", F.lit(True).alias("_a")), F.col("gene_a") == F.col("_seed"), "left")
        .drop("_seed")
        .join(seed.select("_seed", F.lit(True).alias("_b")), F.col("gene_b") == F.col("_seed"), "left")
        .drop("_seed")
        .where("_a or _b")
    )
    if max_total_genes is None:
        return marked.drop("_a", "_b")
    room = max_total_genes - seed.count()
    if room < 0:
        return marked.drop("_a", "_b").limit(0)
    touching = marked.withColumn(
        "_new", F.when(F.col("_a").isNull(), F.col("gene_a")).when(F.col("_b").isNull(), F.col("gene_b"))
    )
    admitted = (
        touching.where("_new is not null")
        .groupBy("_new")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "gene_a", "gene_b")).alias("_best"))
        .orderBy("_best", "_new")
        .limit(room)
        .select("_new", F.lit(True).alias("_in"))
    )
    return touching.join(admitted, "_new", "left").where("_new is null or _in").select(*links.columns)


def gene_pathways(mappings: DataFrame, species: str = DEFAULT_SPECIES) -> DataFrame:
    gene = first_present_column(mappings, ("gene_id", "ensembl_gene_id", "source_id"))
    pathway = first_present_column(mappings, ("pathway_id", "reactome_id", "target_id"))
    rows = mappings.where(F.col("species") == species) if "species" in mappings.columns else mappings
    names = [F.col("pathway_name").cast("string").alias("pathway_name")] if "pathway_name" in rows.columns else []
    shaped = (
        rows.where(F.col(pathway).startswith("R-HSA"))
        .select(
            gene_id(F.col(gene)).alias("gene_id"),
            F.col(pathway).cast("string").alias("pathway_id"),
            F.lit("Reactome").alias("source"),
            *names,
        )
        .where("gene_id is not null")
    )
    return drop_duplicates_by(shaped, ["gene_id", "pathway_id"])


def pathway_hierarchy(hierarchy: DataFrame) -> DataFrame:
    parent = first_present_column(hierarchy, ("parent_id", "parent", "source_id"))
    child = first_present_column(hierarchy, ("child_id", "child", "target_id"))
    return (
        hierarchy.where(F.col(parent).startswith("R-HSA") & F.col(child).startswith("R-HSA"))
        .select(
            F.col(parent).cast("string").alias("parent_pathway_id"),
            F.col(child).cast("string").alias("child_pathway_id"),
            F.lit("Reactome").alias("source"),
        )
        .distinct()
    )


def drug_targets(mechanisms: DataFrame, targets: DataFrame) -> DataFrame:
    drug = first_present_column(mechanisms, ("molecule_chembl_id", "parent_molecule_chembl_id", "drug_id"))
    target = first_present_column(mechanisms, ("target_chembl_id", "target_id"))
    carried = [c for c in ("action_type", "mechanism_of_action") if c in mechanisms.columns]
    hub = targets.select(F.col("source_id").alias("_target"), F.col("ensembl_gene_id").alias("gene_id"))
    shaped = (
        mechanisms.select(
            F.col(drug).cast("string").alias("drug_id"),
            F.col(target).cast("string").alias("target_chembl_id"),
            *[F.col(c).cast("string").alias(c) for c in carried],
        )
        .join(hub, F.col("target_chembl_id") == F.col("_target"))
        .where("gene_id is not null")
        .select("drug_id", "gene_id", "target_chembl_id", *carried)
        # the one shuffle and sort that serve these rows and their edges, one per drug and gene
        .repartition("drug_id", "gene_id")
    )
    return drop_duplicates_by(shaped, ["drug_id", "gene_id", "target_chembl_id"]).select(
        "drug_id", "gene_id", "target_chembl_id", F.lit("ChEMBL").alias("source"), *carried
    )


def gene_annotations(annotations: DataFrame, accessions: DataFrame) -> DataFrame:
    accession = first_present_column(annotations, ("uniprot_id", "db_object_id", "UniProtKB-AC"))
    term = first_present_column(annotations, ("go_id", "GO_ID", "target_id"))
    evidence = optional_column(annotations, ("evidence_code",))
    carried = [F.col(evidence).cast("string").alias(evidence)] if evidence else []
    hub = accessions.select(F.col("source_id").alias("_acc"), F.col("ensembl_gene_id").alias("gene_id"))
    shaped = (
        annotations.where(F.col(term).startswith("GO:"))
        .select(F.col(accession).alias("_acc"), F.col(term).cast("string").alias("go_id"), *carried)
        .join(hub, "_acc")
        .where("gene_id is not null")
        .select("gene_id", "go_id", F.lit("GOA").alias("source"), *([evidence] if evidence else []))
    )
    return drop_duplicates_by(shaped, ["gene_id", "go_id"])


def accession_annotations(annotations: DataFrame, accessions: DataFrame) -> DataFrame:
    """Annotations keyed by accession; duplicates are judged on all four columns."""
    hub = accessions.select(F.col("source_id").alias("uniprot_id"), F.col("ensembl_gene_id").alias("gene_id"))
    return (
        annotations.where("go_id is not null")
        .join(hub, "uniprot_id")
        .where("gene_id is not null")
        .select("gene_id", "go_id", "evidence_code", "source")
        .distinct()
    )


def keep_largest(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Optional cap: rows of the ``limit`` most frequent values of ``column`` (ties by value)."""
    kept = (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(column))
        .limit(limit)
        .select(column)
    )
    return df.join(kept, column, "left_semi")
