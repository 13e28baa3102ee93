from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphrank.operators import explain as X
from graphrank.operators import graph as G
from graphrank.plans import pipeline

GENES = ["ENSG_GDF5", "ENSG_MMP13", "ENSG_NOVEL1", "ENSG_WNT5A", "ENSG_COL2A1"]
PATHWAYS = {"R-HSA-WNT": "Wnt beta-catenin signaling", "R-HSA-BMP": "TGF-beta BMP cartilage differentiation",
            "R-HSA-ECM": "extracellular matrix collagen remodeling"}


@pytest.fixture(scope="module")
def toy(frame):
    disease = [("EFO_0004616", GENES[i]) for i in (0, 1, 3)]
    member = [(GENES[g], list(PATHWAYS)[p]) for g, p in zip((0, 2, 3, 2, 1, 4), (1, 1, 0, 0, 2, 2))]
    near = [(GENES[a], GENES[b]) for a, b in ((0, 2), (3, 2), (1, 4))]
    edges = G.assemble_edges({
        "disease_gene": frame([(*r, 1.0) for r in disease], "disease_id string, gene_id string, score double"),
        "gene_pathway": frame([(*r, "x") for r in member], "gene_id string, pathway_id string, pathway_name string"),
        "gene_gene": frame([(*r, 900.0) for r in near], "gene_a string, gene_b string, score double"),
    })
    attributes = [("Gene", g, g[5:], None) for g in GENES] + [("Pathway", p, None, t) for p, t in PATHWAYS.items()]
    attributes.append(("Disease", "EFO_0004616", None, "knee osteoarthritis"))
    nodes = G.build_nodes(edges, frame(attributes, "node_type string, node_id string, symbol string, label string"))
    return edges, nodes, pipeline.triples(edges, "disease_gene")


def of(edges, name):
    return edges.where(F.col("edge_table") == name)


def test_paths_by_hand(frame, toy):
    edges, nodes, known = toy
    hits = frame([("EFO_0004616", "ENSG_NOVEL1"), ("EFO_0004616", "ENSG_GDF5")], "head string, tail string")
    paths = X.rank_paths(hits, known, of(edges, "gene_pathway"), of(edges, "gene_gene"))
    own = [(r.schema, r.gene, r.pathway, r.score) for r in paths.where("tail = 'ENSG_NOVEL1'").orderBy("path_rank").collect()]
    assert own == [
        (X.LINK_SCHEMA, "ENSG_GDF5", None, 1.9), (X.LINK_SCHEMA, "ENSG_WNT5A", None, 1.9),
        (X.PATHWAY_SCHEMA, "ENSG_GDF5", "R-HSA-BMP", 1.5), (X.PATHWAY_SCHEMA, "ENSG_WNT5A", "R-HSA-WNT", 1.5),
    ]
    itself = paths.where("tail = 'ENSG_GDF5' and gene = tail")
    assert itself.count() == 1  # a known gene explains itself, unless asked not to
    other = X.rank_paths(hits, known, of(edges, "gene_pathway"), of(edges, "gene_gene"), exclude_self=True)
    assert other.where("tail = 'ENSG_GDF5' and gene = tail").count() == 0
    record = X.path_records(paths, nodes).where("tail = 'ENSG_NOVEL1' and path_rank = 3").first()
    assert [n.label for n in record.nodes] == ["knee osteoarthritis", "GDF5", PATHWAYS["R-HSA-BMP"], "NOVEL1"]
    assert [e.rel for e in record.edges] == ["associated_with", "participates_in", "participates_in"]


def test_paths_of_a_crowded_pathway_are_cut_exactly(frame):
    genes = [f"g{i:02d}" for i in range(30)]
    known = frame([("d", "r", g) for g in genes[:20]], "head string, relation string, tail string")
    member = frame([(g, p) for p in ("big", "also") for g in genes] + [(g, "small") for g in genes[15:26]], "source_id string, target_id string")
    links = frame([], "source_id string, target_id string")
    hits = frame([("d", "g25")], "head string, tail string")
    got = [(r.gene, r.pathway) for r in X.rank_paths(hits, known, member, links, 9).orderBy("path_rank").collect()]
    want = [(g, "small") for g in genes[15:20]] + sorted((g, p) for g in genes[:20] for p in ("big", "also"))
    assert got == want[:9]


def test_rationales_by_hand(toy):
    edges, _, _ = toy
    typed = G.with_reverse(G.typed_edges(edges))
    weights = X.edge_rationales(typed, [("EFO_0004616", "ENSG_GDF5")])
    rows = {(r.edge_type, r.src, r.dst): r.weight for r in weights.collect()}
    assert rows["disease__associated_with__gene", "EFO_0004616", "ENSG_GDF5"] == 1.0
    assert rows["disease__associated_with__gene", "EFO_0004616", "ENSG_MMP13"] == pytest.approx(0.75 / 2.45)
    assert rows["gene__interacts__gene", "ENSG_WNT5A", "ENSG_NOVEL1"] == pytest.approx(0.05 / 0.75)
    top = X.top_edges(weights, 6, layers=2)
    assert top.count() == 6 and {r.layer for r in top.collect()} == {0, 1}
    summary = {r.edge_type for r in X.relation_summary(top).collect()}
    assert "disease__associated_with__gene" in summary
    with pytest.raises(ValueError):
        X.edge_rationales(typed, [])


def test_ranking_and_lookup(frame, toy):
    edges, nodes, known = toy
    assert X.find_node(nodes, "disease", "KNEE osteoarthritis") == "EFO_0004616"
    assert X.find_node(nodes, "gene", "ensg_wnt5a") == "ENSG_WNT5A"
    with pytest.raises(KeyError):
        X.find_node(nodes, "gene", "absent")
    with pytest.raises(ValueError):
        X.rank_targets(known.withColumn("score", F.lit(1.0)), known, 101)
    out = pipeline.predict(edges, nodes, "efo_0004616", top_k=2).orderBy("rank").collect()
    assert [(r.tail, r.known, r.hypothesis) for r in out] == [("ENSG_GDF5", True, False), ("ENSG_MMP13", True, False)]
    assert out[0].paths[0].path_rank == 1


def test_cases_prefer_known_targets_then_novel_ones(frame, toy):
    edges, nodes, known = toy
    scored = frame([("EFO_0004616", "ENSG_NOVEL1", 0.99), ("EFO_0004616", "ENSG_WNT5A", 0.5)], "head string, tail string, score double")
    assert X.select_known_target(nodes) == "ENSG_GDF5"
    with pytest.raises(ValueError):
        X.select_known_target(nodes, ["none"])
    positives = known.select("head", "tail")
    cases = X.select_cases(nodes, scored, positives, "EFO_0004616", minimum=4)
    rows = cases.orderBy("case_no").collect()
    assert [(r.symbol, r.known_target, r.score) for r in rows] == [
        ("GDF5", True, None), ("MMP13", True, None), ("NOVEL1", False, 0.99), ("COL2A1", False, None)]
    hits = cases.select(F.col("disease").alias("head"), F.col("gene").alias("tail"))
    paths = X.rank_paths(hits, known, of(edges, "gene_pathway"), of(edges, "gene_gene"), 8)
    labels = nodes.select("node_id", F.coalesce("symbol", "label").alias("label"))
    terms = X.keyword_hits(paths, labels)
    assert {r.tail: r.terms for r in terms.collect()}["ENSG_NOVEL1"] == ["beta-catenin", "bmp", "cartilage", "tgf", "wnt"]
    told = X.case_narratives(cases, paths.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("paths")), terms)
    text = {r.symbol: r.narrative for r in told.collect()}
    assert "known-target sanity check" in text["GDF5"] and "computational hypothesis" in text["NOVEL1"]


def test_attributions(frame):
    features = frame([("gene", "a", [0, 1], [1.0, -2.0]), ("gene", "b", [0], [4.0])],
                     "node_type string, node_id string, indices array<int>, entries array<double>")
    weights = frame([("gene", 0, 0.5), ("gene", 1, 3.0)], "node_type string, feature_idx int, weight double")
    made = X.linear_attributions(features, weights)
    assert {r.node_id: r.importance for r in X.node_importance(made).collect()} == {"a": 1.0, "b": pytest.approx(2.0 / 6.5)}
    sizes = frame([("gene", 2)], "node_type string, nodes bigint")
    assert {r.feature_idx: r.importance for r in X.feature_importance(made, sizes).collect()} == {0: pytest.approx(2.5 / 6), 1: 1.0}
    assert {r.node_id: r.importance for r in X.node_importance(X.linear_attributions(features)).collect()} == {"a": 0.75, "b": 1.0}


def test_only_pathways_and_genes_next_to_a_hit_fan_out(frame, capsys):
    hits = frame([("D1", "G1"), ("D2", "G1")], "head string, tail string")
    known = frame([(f"D{d}", f"G{g}") for d in (1, 2) for g in range(2, 8)], "head string, tail string")
    member = frame([("G1", "P1"), ("G2", "P1"), ("G3", "P2"), ("G4", "P2"), ("G5", "P1")], "source_id string, target_id string")
    shared = X.shared_pathway_paths(hits, known, member)
    near = X.neighbour_paths(hits, known, frame([("G1", "G6"), ("G7", "G1"), ("G2", "G3")], "src string, dst string"))
    assert {(r.head, r.gene, r.pathway) for r in shared.collect()} == {(d, g, "P1") for d in ("D1", "D2") for g in ("G2", "G5")}
    assert {(r.head, r.gene) for r in near.collect()} == {(d, g) for d in ("D1", "D2") for g in ("G6", "G7")}
    for paths, filters in ((shared, 3), (near, 3)):
        paths.explain()
        assert capsys.readouterr().out.count("LeftSemi") >= filters
