from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphrank.functions import columns as C
from graphrank.operators import normalize as N


def test_accessions_are_split_and_versionless(frame):
    raw = frame([("P1", "ENSG00000123456.7; ENSG00000123457"), ("P2", "not-a-gene"), ("P3", "ENSG00000123458"), ("P4", None)],
                "`From` string, `To` string")
    got = {tuple(r) for r in N.map_accessions(raw).collect()}
    assert got == {("UniProt", "P1", "ENSG00000123456"), ("UniProt", "P1", "ENSG00000123457"), ("UniProt", "P3", "ENSG00000123458")}


def test_proteins_and_targets_reach_the_hub(frame):
    info = frame([("9606.ENSP1", "ENSG00000111111.1")], "protein_external_id string, ensembl_gene_id string")
    acc = N.map_accessions(frame([("P1", "ENSG00000111111"), ("P2", "ENSG00000133333")], "`From` string, `To` string"))
    targets = frame([("T1", "P1"), ("T2", "P2"), ("T3", "P9")], "target_chembl_id string, uniprot_id string")
    assert ("STRING", "9606.ENSP1", "ENSG00000111111") in {tuple(r) for r in N.map_proteins(info).collect()}
    mapped = N.map_targets(targets, acc)
    assert {(r.source_id, r.ensembl_gene_id) for r in mapped.collect()} == {("T1", "ENSG00000111111"), ("T2", "ENSG00000133333")}
    assert N.combine(mapped, mapped, acc).count() == 4


def test_coverage_gate_is_strict(frame):
    genes = [f"ENSG{i:011d}" for i in range(10)]
    seeds = frame([(g + ".2",) for g in genes], "ensembl_gene_id string")
    mapped = frame([(g,) for g in genes[:9]], "ensembl_gene_id string")
    row = N.coverage_report(seeds, mapped).first()
    assert (row.seed_gene_count, row.mapped_seed_gene_count, row.coverage, row.passes) == (10, 9, 0.9, False)
    assert [r.ensembl_gene_id for r in N.unmapped_genes(seeds, mapped).collect()] == [genes[9]]
    empty = N.coverage_report(seeds.limit(0), mapped).first()
    assert empty.coverage == 0.0 and not empty.passes


def test_missing_columns_raise(frame):
    df = frame([(1,)], "a int")
    with pytest.raises(KeyError):
        C.first_present_column(df, ["x", "y"])
    with pytest.raises(KeyError):
        C.ensure_columns(df, ["a", "b"])
    assert C.optional_column(df, ["x"]) is None


def test_scalars(frame):
    df = frame([("[1, 2.5]", "P", "7"), ("3 4", None, "x"), ("", "Cellular_Component", None)], "v string, ns string, n string")
    rows = df.select(C.parse_vector(F.col("v")).alias("v"), C.go_namespace(F.col("ns")).alias("ns"), C.numeric(F.col("n"), 5.0).alias("n")).collect()
    assert [r.v for r in rows] == [[1.0, 2.5], [3.0, 4.0], None]
    assert [r.ns for r in rows] == ["BP", "BP", "CC"]
    assert [r.n for r in rows] == [7.0, 5.0, 5.0]


def brute_expand(seeds, links, cap):
    """Greedy walk over the links from best to worst."""
    kept, out = set(seeds), []
    for a, b, s in sorted((x for x in links if x[0] in seeds or x[1] in seeds), key=lambda x: (-x[2], x[0], x[1])):
        if len(kept | {a, b}) <= cap:
            kept |= {a, b}
            out.append((a, b, s))
    return set(out)


@pytest.mark.parametrize("seed", range(6))
def test_capped_expansion_equals_the_greedy_walk(frame, seed):
    rng = random.Random(seed)
    names = [f"g{i:02d}" for i in range(14)]
    links = list({(a, b): (a, b, float(rng.randint(1, 4))) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(40)) if a != b}.values())
    seeds = set(rng.sample(names, 3)) | {"absent"}
    cap = rng.randint(2, 10)
    got = N.expand_one_hop(frame([(g,) for g in seeds], "gene_id string"), frame(links, "gene_a string, gene_b string, score double"), cap)
    assert {tuple(r) for r in got.collect()} == brute_expand(seeds, links, cap)


def test_edge_sources_drop_what_does_not_belong(frame):
    pathways = frame([("ENSG00000000001.2", "R-HSA-1", "a", "Homo sapiens"), ("ENSG00000000001", "R-HSA-1", "b", "Homo sapiens"),
                      ("ENSG00000000002", "R-MMU-1", "a", "Homo sapiens"), ("ENSG00000000003", "R-HSA-2", "a", "Mus musculus")],
                     "gene_id string, pathway_id string, pathway_name string, species string")
    assert [(r.gene_id, r.pathway_id, r.pathway_name) for r in N.gene_pathways(pathways).collect()] == [("ENSG00000000001", "R-HSA-1", "a")]
    links = frame([("ENSG00000000001", "ENSG00000000001", 900.0), ("ENSG00000000001", "ENSG00000000002", 700.0),
                   ("ENSG00000000001", "ENSG00000000002", 800.0), ("ENSG00000000002", "ENSG00000000001", 699.0)],
                  "gene_a string, gene_b string, score double")
    assert [tuple(r) for r in N.gene_links(links).collect()] == [("ENSG00000000001", "ENSG00000000002", 800.0)]
    scored = frame([("EFO_0004616", "ENSG00000000001", "0.5"), ("EFO_0004616", "ENSG00000000001", "0.7"), ("EFO_1", "ENSG00000000002", "0.9"),
                    ("EFO_0004616", None, "0.9")], "diseaseId string, targetId string, score string")
    assert [(r.gene_id, r.score) for r in N.disease_genes(scored).collect()] == [("ENSG00000000001", 0.7)]
