"""Table schemas and the fixed vocabulary of the typed graph."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# --- fixed values: relations of the graph, (source type, relation, target type) per edge table
EDGE_SCHEMAS = {
    "disease_gene": ("Disease", "associated_with", "Gene"),
    "gene_gene": ("Gene", "interacts", "Gene"),
    "gene_pathway": ("Gene", "participates_in", "Pathway"),
    "drug_gene": ("Drug", "targets", "Gene"),
    "gene_go": ("Gene", "annotated_with", "GOTerm"),
    "pathway_pathway": ("Pathway", "parent_of", "Pathway"),
}
# --- fixed values: every edge table but the pathway hierarchy is required
OPTIONAL_EDGE_TABLES = ("pathway_pathway",)
# --- fixed values: source label of each edge table
EDGE_SOURCES = {
    "disease_gene": "Open Targets",
    "gene_gene": "STRING",
    "gene_pathway": "Reactome",
    "drug_gene": "ChEMBL",
    "gene_go": "GOA",
    "pathway_pathway": "Reactome",
}
# --- fixed values: endpoint columns and carried properties of each edge table
EDGE_ENDPOINTS = {
    "disease_gene": ("disease_id", "gene_id"),
    "gene_gene": ("gene_a", "gene_b"),
    "gene_pathway": ("gene_id", "pathway_id"),
    "drug_gene": ("drug_id", "gene_id"),
    "gene_go": ("gene_id", "go_id"),
    "pathway_pathway": ("parent_pathway_id", "child_pathway_id"),
}
EDGE_PROPERTIES = {
    "disease_gene": ("score",),
    "gene_gene": ("score",),
    "gene_pathway": ("pathway_name",),
    "drug_gene": ("target_chembl_id", "action_type", "mechanism_of_action"),
    "gene_go": ("evidence_code",),
    "pathway_pathway": (),
}
# --- fixed values: lower-snake names of the node types
NODE_TYPE_NAMES = {
    "Disease": "disease",
    "Gene": "gene",
    "Pathway": "pathway",
    "Drug": "drug",
    "GOTerm": "go_term",
}
# --- fixed values: the relation without a reverse, and the relations whose links are predicted
SYMMETRIC_RELATIONS = ("interacts",)
PREDICTED_RELATIONS = ("associated_with", "targets", "participates_in")

# --- fixed values: headerless association file, 17 text columns
GAF = _strings(
    "db",
    "db_object_id",
    "db_object_symbol",
    "qualifier",
    "go_id",
    "db_reference",
    "evidence_code",
    "with_or_from",
    "aspect",
    "db_object_name",
    "db_object_synonym",
    "db_object_type",
    "taxon",
    "date",
    "assigned_by",
    "annotation_extension",
    "gene_product_form_id",
)
# --- fixed values: headerless gene-to-pathway file, 6 text columns
GENE_PATHWAY_FILE = _strings(
    "gene_id", "pathway_id", "url", "pathway_name", "evidence_code", "species"
)
CROSSWALK = _strings("source_namespace", "source_id", "ensembl_gene_id")
EDGE_KEYS = ("source_id", "target_id", "source_type", "edge_type", "target_type")
EDGE_COLUMNS = EDGE_KEYS + ("source",)
EDGE_PROPERTY_TYPES = {
    "score": "double",
    "pathway_name": "string",
    "target_chembl_id": "string",
    "action_type": "string",
    "mechanism_of_action": "string",
    "evidence_code": "string",
}
