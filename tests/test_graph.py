from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphrank.functions import vectors as V
from graphrank.operators import features as X
from graphrank.operators import graph as G
from graphrank.operators import propagation as P
from graphrank.operators.normalize import drug_targets
from graphrank.operators.ordering import dense_index, with_running_sums
from graphrank.plans.pipeline import build_and_store

A, B = "ENSG00000123456", "ENSG00000111111"


@pytest.fixture(scope="module")
def tables(frame):
    return {
        "disease_gene": frame([("D", A, 0.9), ("D", B, 0.4)], "disease_id string, gene_id string, score double"),
        "gene_gene": frame([(A, B, 900.0), (B, A, 800.0)], "gene_a string, gene_b string, score double"),
        "gene_pathway": frame([(A, "R-HSA-1", "x"), (B, "R-HSA-1", "x")], "gene_id string, pathway_id string, pathway_name string"),
        "drug_gene": frame([("CHEMBL1", A, "T1", "INHIBITOR")], "drug_id string, gene_id string, target_chembl_id string, action_type string"),
        "gene_go": frame([(A, "GO:1", "IDA"), (B, "GO:1", "IEA")], "gene_id string, go_id string, evidence_code string"),
    }


def test_assembly_statistics_and_presence(frame, tables):
    edges = G.assemble_edges(tables)
    G.assert_edges(edges)
    attributes = frame([(A, "Gene", "GDF5"), (B, "Gene", "MMP13")], "node_id string, node_type string, symbol string")
    nodes = G.build_nodes(edges, attributes)
    stats = {(r.metric, r.name): r.value for r in G.graph_statistics(nodes, edges).collect()}
    assert stats["node_count", "Disease"] == 1 and stats["edge_count", "disease_gene"] == 2
    assert stats["positive_disease_gene_links", "Open Targets"] == 2
    assert stats["density", "global"] == pytest.approx(9 / 30) and stats["mean_degree", "global"] == pytest.approx(3.0)
    wanted = frame([("FRZB",), ("gdf5",), ("MMP13",)], "gene string")
    assert {r.gene: r.present for r in G.known_gene_presence(nodes, wanted).collect()} == {"FRZB": False, "GDF5": True, "MMP13": True}
    assert G.check_node_range(nodes, 1, 20).first().in_range and not G.check_node_range(nodes, 7, 20).first().in_range
    assert G.degree_distribution(edges).first().node_id == A
    assert G.unique_key_violations(nodes).isEmpty()


def test_validation_reports_every_error(tables):
    edges = G.assemble_edges({k: v for k, v in tables.items() if k != "gene_go"})
    wrong = edges.withColumn("target_type", F.when(F.col("edge_table") == "drug_gene", "Drug").otherwise(F.col("target_type")))
    errors = {(r.edge_table, r.error.split()[0]) for r in G.validate_edges(wrong).collect()}
    assert errors == {("gene_go", "missing"), ("drug_gene", "unexpected")}
    with pytest.raises(ValueError):
        G.assert_edges(wrong)
    with pytest.raises(KeyError):
        G.assemble_edges({"part_part": tables["gene_gene"]})


def brute_pagerank(pairs, rounds):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rank = {v: 1 / len(near) for v in near}
    for _ in range(rounds):
        new = {v: 0.15 / len(near) for v in near}
        for v, others in near.items():
            for o in others:
                new[o] += 0.85 * rank[v] / len(others)
        rank = new
    return rank


@pytest.mark.parametrize("slot_size", [2, 1000])
def test_pagerank_with_hub_in_slots(frame, slot_size):
    rng = random.Random(1)
    pairs = [("hub", f"n{i}") for i in range(30)] + [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)]
    got = {r.node: r.pagerank for r in P.pagerank(frame(pairs, "src string, dst string"), 7, slot_size=slot_size).collect()}
    want = brute_pagerank(pairs, 7)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


@pytest.mark.parametrize("slot_size", [1, 1000])
def test_pagerank_with_null_ends_leaves_no_shuffle_files(spark, frame, slot_size):
    """A null end counts as a neighbour and as a node, but has no rank and passes none on."""
    pairs = [("a", "b"), ("a", None), ("b", "c"), ("c", "a"), (None, "b"), ("b", "a"), (None, "alone")]
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    table = P.pagerank(frame(pairs, "src string, dst string"), 6, slot_size=slot_size)
    # rounds and numbers are stored: lists of the links may be kept, no round's shuffles are
    assert files.getAllFiles().size() - before < 40
    near = {"a": 3, "b": 3, "c": 2}  # the null node with them
    rank = dict.fromkeys([*near, "alone"], 1 / 5)
    for _ in range(6):
        rank = {v: 0.15 / 5 + 0.85 * sum(rank[o] / n for o, n in near.items() if o != v) for v in near}
    got = {r.node: r.pagerank for r in table.collect()}
    assert got.keys() == rank.keys() and all(got[k] == pytest.approx(rank[k], rel=1e-12) for k in rank)


def test_depths_of_a_graph_with_shared_paths_and_a_cycle(frame):
    links = frame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("r", "d")], "p string, c string")
    assert {r.node: r.depth for r in P.depths(links, "p", "c").collect()} == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 1}


def test_structural_embeddings_match_singular_vectors(frame):
    rng = np.random.default_rng(3)
    n = 24
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (i % 3 == j % 3 and rng.random() < 0.8) or rng.random() < 0.05]
    names = [f"v{i:02d}" for i in range(n)]
    got = P.structural_embeddings(frame([(names[i], names[j]) for i, j in pairs], "src string, dst string"), dim=3, iterations=40)
    rows = {r.node: np.array(r.vector) for r in got.collect()}
    m = np.eye(n)
    for i, j in pairs:
        m[i, j] = m[j, i] = 1.0
    u, sv, _ = np.linalg.svd(m)
    want = u[:, :3] * np.sqrt(sv[:3])
    have = np.array([rows[x] for x in names])
    assert np.allclose(have @ have.T, want @ want.T, atol=1e-6)


def test_a_round_of_structural_embeddings_joins_nodes_not_links(frame, monkeypatch):
    rounds, store = [], P.Rounds.store
    monkeypatch.setattr(P.Rounds, "store", lambda self, df: (rounds.append(df), store(self, df))[1])
    pairs = [("hub", f"v{i}") for i in range(9)] + [("v1", "v2"), ("v3", "v4")]
    rows = P.structural_embeddings(frame(pairs, "src string, dst string"), dim=4, iterations=8, slot_size=2).collect()
    assert rounds and all("ids" in df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0] for df in rounds)
    nodes = sorted({n for p in pairs for n in p})
    m = np.eye(len(nodes))
    for a, b in pairs:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = 1.0
    values, vectors = np.linalg.eigh(m)
    top = np.argsort(-np.abs(values))[:1]
    have = np.array([r.vector for r in sorted(rows, key=lambda r: r.node)])
    assert np.allclose(np.abs(have[:, 0]), np.abs(vectors[:, top[0]]) * np.sqrt(np.abs(values[top[0]])), atol=1e-3)


def test_features_of_every_type(frame, tables):
    edges = G.assemble_edges(tables)
    nodes = G.build_nodes(edges)
    rows = {(r.node_type, r.node_id): r for r in X.all_features(nodes, edges, "go").collect()}
    assert rows["gene", A].width == 3 and rows["gene", A].entries[0] == 6.0 and rows["gene", A].indices == [0, 1, 2]
    assert rows["drug", "CHEMBL1"].width == 2048 and 1 <= len(rows["drug", "CHEMBL1"].indices) <= 32
    assert rows["pathway", "R-HSA-1"].entries == [2.0, 0.0]
    assert rows["go_term", "GO:1"].entries == [1.0, 0.0, 0.0, 0.0]
    assert rows["disease", "D"].width == 1
    hot = X.gene_features(nodes, edges, "none").collect()
    assert sorted(r.indices[0] for r in hot) == [0, 1] and {r.width for r in hot} == {2}


def brute_hashed(text, dim):
    import hashlib

    v = np.zeros(dim)
    words = text.lower().replace("_", " ").split() or [text or "missing"]
    for w in words:
        d = hashlib.sha256(w.encode()).digest()
        v[int.from_bytes(d[:8], "big") % dim] += -1.0 if d[8] % 2 else 1.0
    size = np.linalg.norm(v)
    return v / size if size else v


def test_hashed_vectors(frame):
    texts = ["Wnt signalling_pathway wnt", "", "__", "one two\tthree", "a b c d e f g"]
    df = frame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.vector for r in V.hashed_vectors(df, "id", F.col("text"), 12).collect()}
    short = {r.id: r.v for r in df.select("id", V.id_vector(F.col("text"), 12).alias("v")).collect()}
    for i, text in enumerate(texts):
        assert np.allclose(got[i], brute_hashed(text, 12)) and np.allclose(short[i], brute_hashed(text, 12))


def test_dense_index_and_running_sums_under_any_partitioning(frame):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if rng.random() < 0.6 else "hot", i, rng.randint(0, 5)) for i in rng.sample(range(1000), 300)]
    for parts in (1, 7):
        df = frame(rows, "k string, o int, v int").repartition(parts)
        got = {(r.k, r.o): r.idx for r in dense_index(df, ["k"], [F.desc("o")]).collect()}
        sums = {(r.k, r.o): r.before_v for r in with_running_sums(df.withColumn("o", F.col("o").cast("double")), ["k"], "o", ["v"]).collect()}
        for k, o, _ in rows:
            assert got[k, o] == sum(1 for r in rows if r[0] == k and r[1] > o)
            assert sums[k, float(o)] == sum(r[2] for r in rows if r[0] == k and r[1] < o)


def test_nodes_are_read_off_the_stored_edges(frame, tables, tmp_path, monkeypatch):
    """Storing a built graph computes its edges once."""
    read = []

    def recorded(edges, attributes=None, build=G.build_nodes):
        read.append(edges.inputFiles())
        return build(edges, attributes)

    monkeypatch.setattr(G, "build_nodes", recorded)
    mapping = frame([(f"P{i}", f"ENSG0000000000{i}") for i in range(4)], "uniprot_id string, ensembl_gene_id string")
    raw = {
        "associations": frame([("D", "ENSG00000000001", 1.0)], "disease_id string, target_id string, score double"),
        "protein_links": frame([("a", "b", 900.0)], "protein1 string, protein2 string, score double"),
        "proteins": frame([("a", "ENSG00000000001"), ("b", "ENSG00000000002")], "protein string, ensembl_gene_id string"),
        "accessions": mapping,
        "targets": frame([("T", "P3")], "target_chembl_id string, uniprot_id string"),
        "mechanisms": frame([("C", "T", "x")], "drug_id string, target_chembl_id string, action_type string"),
        "pathways": frame([("ENSG00000000002", "R-HSA-1")], "gene_id string, pathway_id string"),
        "annotations": frame([("P0", "GO:1")], "uniprot_id string, go_id string"),
    }
    edges, nodes = build_and_store(raw, str(tmp_path), disease=None)
    assert edges.count() == 5 and nodes.count() == 8
    assert any(files and all(str(tmp_path) in f for f in files) for files in read)


def test_edges_of_drugs_take_one_shuffle(spark, frame, capsys):
    rows = [("d1", "t1", None, "m"), ("d1", "t1", "b", "z"), ("d1", "t1", "b", "a"), ("d1", "t2", "a", "n"), ("d2", "t1", None, None), (None, "t1", "a", "m"), (None, "t1", "a", "l")]
    mechanisms = frame(rows, "drug_id string, target_chembl_id string, action_type string, mechanism_of_action string")
    targets = frame([("t1", "g"), ("t2", "g"), ("t2", "k")], "source_id string, ensembl_gene_id string")
    made = drug_targets(mechanisms, targets)
    want = [("d1", "g", "t1", "b", "a"), ("d1", "g", "t2", "a", "n"), ("d1", "k", "t2", "a", "n"), ("d2", "g", "t1", None, None), (None, "g", "t1", "a", "l")]
    assert {tuple(r[c] for c in ("drug_id", "gene_id", "target_chembl_id", "action_type", "mechanism_of_action")) for r in made.collect()} == set(want)
    assert made.count() == len(want)
    edges = G.assemble_edges({"drug_gene": made})
    assert {(r["source_id"], r["target_id"]): r["target_chembl_id"] for r in edges.collect()} == {("d1", "g"): "t1", ("d1", "k"): "t2", ("d2", "g"): "t1", (None, "g"): "t1"}
    G.assemble_edges({"drug_gene": made}).explain()
    plan = capsys.readouterr().out
    assert sum("Exchange" in line and "drug_id" in line for line in plan.splitlines()) == 1 and "Window" not in plan
