"""Fits against numpy, sparse messages against dense ones, full ranks against a loop over all tails."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphrank.operators import fullrank as R
from graphrank.operators import propagation as P
from graphrank.operators import training as T
from graphrank.plans import training as J


def descent(x, y, epochs, rate=0.2, l2=1e-4):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * (x.T @ error / len(y) + l2 * w), b - rate * error.mean()
    return w, b


def test_many_fits_in_one_loop(frame):
    rng = np.random.default_rng(1)
    data = {fit: (rng.normal(size=(n, 3)), rng.integers(0, 2, n).astype(float)) for fit, n in ((0, 50), (1, 7), (5, 300))}
    rows = [(fit, x.tolist(), float(label)) for fit, (xs, ys) in data.items() for x, label in zip(xs, ys)]
    fits = T.fit_many(frame(rows, "fit int, features array<double>, label double").repartition(5), epochs=30)
    for fit, (x, y) in data.items():
        w, b = descent(x, y, 30)
        assert np.allclose(fits[fit].weights, w) and abs(fits[fit].bias - b) < 1e-12


def test_early_stopping_keeps_the_best_epoch(frame):
    rows = [(fit, [1.0, float(i % 3)], float(i % 2)) for fit in (0, 1) for i in range(20)]
    values = {0: [0.1, 0.5, 0.3, 0.2, 0.4, 0.45], 1: [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]}
    seen = []

    def validate(fits):
        seen.append(sorted(fits))
        return {f: {"auprc": values[f][len(seen) - 1] / 2, "filtered_mrr": values[f][len(seen) - 1] / 2} for f in fits}

    fits = T.fit_many(frame(rows, "fit int, features array<double>, label double"), epochs=6, validate=validate, patience=2)
    assert (fits[0].best_epoch, fits[1].best_epoch) == (1, 5)
    assert seen == [[0, 1]] * 4 + [[1]] * 2 and len(fits[0].history) == 4
    x, y = np.array([r[1] for r in rows[:20]]), np.array([r[2] for r in rows[:20]])
    assert np.allclose(fits[0].weights, descent(x, y, 2)[0])


@pytest.fixture(scope="module")
def typed(frame):
    rows = [("a", "r", "b", f"a{i}", f"b{(i * j) % 7}") for i in range(9) for j in range(1, 4)]
    rows += [("b", "rev_r", "a", d, s) for _, _, _, s, d in rows] + [("a", "s", "a", "a1", f"a{i}") for i in range(9)]
    return frame(sorted(set(rows)), "src_type string, relation string, dst_type string, src string, dst string")


def test_sparse_means_equal_dense_ones(frame, typed):
    nodes = [("a", f"a{i}") for i in range(9)] + [("b", f"b{i}") for i in range(7)]
    values = {n: [float(k), 0.0 if k % 2 else 1.0 + k] for k, n in enumerate(nodes)}
    dense = frame([(*n, v) for n, v in values.items()], "node_type string, node_id string, x array<double>")
    entries = frame([(*n, c, v[c]) for n, v in values.items() for c in (0, 1) if v[c]], "node_type string, node_id string, column int, value double")
    for hops in (1, 2):
        want = {r["node_id"]: r["x"] for r in P.relation_means(typed, dense, 2, hops).collect()}
        got: dict = {n: [0.0, 0.0] for _, n in nodes}
        for r in T.sparse_means(T.message_weights(typed), entries, hops).collect():
            got[r["node_id"]][r["column"]] = r["value"]
        assert all(np.allclose(got[n], want[n]) for _, n in nodes)


def test_hashing_commutes_with_messages_and_keeps_sums(frame, typed):
    entries = frame([("a", f"a{i}", 100 * i + c, 1.0 + c) for i in range(9) for c in range(3)] + [("b", "b0", 5, 2.0)],
                    "node_type string, node_id string, column int, value double")
    weighted = T.message_weights(typed)
    # columns keep the type of the node they came from only when they are hashed first
    first = {(r["node_id"], r["column"]): r["value"] for r in T.sparse_means(weighted, T.hashed_entries(entries, 4), 1).collect()}
    again = {(r["node_id"], r["column"]): r["value"] for r in T.sparse_means(weighted, T.hashed_entries(entries.repartition(7), 4), 1).collect()}
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-12 for k in first)
    assert {c for _, c in first} <= set(range(4))
    vectors = T.node_vectors(frame([("a", "a0"), ("c", "none")], "node_type string, node_id string"), T.hashed_entries(entries, 4), 4).collect()
    lengths = {r["node_id"]: sum(v * v for v in r["vector"]) for r in vectors}
    assert abs(lengths["a0"] - 1) < 1e-12 and lengths["none"] == 0


def test_a_node_is_one_row_and_an_edge_one_message(frame, typed):
    nodes = [("a", f"a{i}") for i in range(9)] + [("b", f"b{i}") for i in range(7)]
    entries = frame([(*n, 10 * k + c, 0.5 + c * k) for k, n in enumerate(nodes[:-2]) for c in range(1 + k % 4)], "node_type string, node_id string, column int, value double")
    weighted, rows = T.message_weights(typed), T.hashed_rows(entries, 4)
    assert rows.count() == len(nodes) - 2
    named = frame([*nodes, ("c", "none")], "node_type string, node_id string")
    for hops in (0, 1, 2):
        long = T.sparse_means(weighted, T.hashed_entries(entries, 4), hops) if hops else T.hashed_entries(entries, 4)
        packed = T.sparse_means(weighted, rows, hops, 4) if hops else rows
        assert packed.count() == packed.select("node_type", "node_id").distinct().count()
        want = {r["node_id"]: r["vector"] for r in T.node_vectors(named, long, 4).collect()}
        got = {r["node_id"]: r["vector"] for r in T.node_vectors(named, packed, 4).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[n], want[n], atol=1e-12) for n in want)


def test_scores_recomputed_in_sql(frame):
    vectors = frame([(f"n{i}", [float(i), 1.0 - i, 0.5 * i]) for i in range(6)], "node_id string, vector array<double>")
    links = frame([(f"n{i}", "r", f"n{(i * 2) % 7}") for i in range(6)], "head string, relation string, tail string")
    fit = T.LinearFit(np.arange(12) / 10 - 0.4, 0.25)
    got = {(r["head"], r["tail"]): r["score"] for r in T.linear_scores(fit, links, vectors).collect()}
    con = duckdb.connect()
    for (head, tail), score in got.items():
        h, t = ([float(k), 1.0 - k, 0.5 * k] if k < 6 else [0.0] * 3 for k in (int(head[1:]), int(tail[1:])))
        x = h + t + [abs(a - b) for a, b in zip(h, t)] + [a * b for a, b in zip(h, t)]
        want = con.execute("SELECT list_dot_product(?::DOUBLE[], ?::DOUBLE[]) + ?", [x, fit.weights.tolist(), fit.bias]).fetchone()[0]
        assert abs(score - want) < 1e-9


@pytest.mark.parametrize("filtered", [True, False])
def test_full_ranks_against_a_loop(frame, monkeypatch, filtered):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.default_rng(3)
    q = {(f"h{i}", r): rng.integers(-3, 4, 4).astype(float) for i in range(12) for r in "xy"}
    t = {(r, f"t{i:02d}"): rng.integers(-2, 3, 4).astype(float) for i in range(40) for r in "xy"}
    known = {(h, r, f"t{rng.integers(40):02d}") for h, r in q for _ in range(6)}
    positives = sorted(known)[::3] + [("h0", "x", "t39")]
    got = R.product_ranks(
        frame(positives, "head string, relation string, tail string"), frame(sorted(known), "head string, relation string, tail string"),
        frame([(*k, v.tolist()) for k, v in q.items()], "head string, relation string, vector array<double>"),
        frame([(*k, v.tolist()) for k, v in t.items()], "relation string, tail string, vector array<double>"), filtered).collect()
    assert len(got) == len(set(positives))
    for r in got:
        head, relation, tail = r["head"], r["relation"], r["tail"]
        own = float(q[head, relation] @ t[relation, tail])
        others = [float(q[head, relation] @ v) for (rel, name), v in t.items()
                  if rel == relation and name != tail and not (filtered and (head, relation, name) in known)]
        assert r["rank"] == 1 + sum(s > own for s in others) + 0.5 * sum(s == own for s in others)


def test_full_ranks_copy_positives_to_few_blocks(frame, monkeypatch):
    """Tails are packed in large blocks, multiplied slice by slice."""
    met = []

    def counted(pairs, count=R._counts):
        met.append(pairs.count())
        return count(pairs)

    monkeypatch.setattr(R, "_counts", counted)
    tails = [("r", f"t{i:04d}", [float(i % 97), 1.0]) for i in range(1300)]
    known = [("h", "r", f"t{i:04d}") for i in (3, 700, 1299)]
    triple = "head string, relation string, tail string"
    got = R.product_ranks(frame(known, triple), frame(known, triple), frame([("h", "r", [2.0, 1.0])], "head string, relation string, vector array<double>"),
                          frame(tails, "relation string, tail string, vector array<double>")).collect()
    assert met == [1]
    for r in got:
        own = int(r["tail"][1:])
        others = [i % 97 for i in range(1300) if i not in (3, 700, 1299)]
        assert r["rank"] == 1 + sum(v > own % 97 for v in others) + 0.5 * sum(v == own % 97 for v in others)


def test_full_ranks_want_vectors(frame):
    one = frame([("h", "r", "t")], "head string, relation string, tail string")
    none = frame([], "head string, relation string, vector array<double>")
    tails = frame([("r", "t", [1.0])], "relation string, tail string, vector array<double>")
    with pytest.raises(KeyError):
        R.product_ranks(one, one, none, tails)


def test_job_fits_and_sees_all_nodes(spark, frame):
    """A fit tells its examples apart; a gene without a link has a vector too."""
    rows = [("disease_gene", f"D{i}", "Disease", "associated_with", "Gene", f"G{j}") for i in range(12) for j in range(20) if (i + j) % 2 == 0]
    rows += [("gene_gene", f"G{j}", "Gene", "interacts", "Gene", f"G{(j + 2) % 20}") for j in range(20)] + [("gene_gene", "G1", "Gene", "interacts", "Gene", "G99")]
    edges = frame(rows, "edge_table string, source_id string, source_type string, edge_type string, target_type string, target_id string")
    nodes = frame([("Disease", f"D{i}") for i in range(12)] + [("Gene", f"G{j}") for j in [*range(20), 99]], "node_type string, node_id string")
    links = J.splits.split_links(edges.where("edge_table = 'disease_gene'").select("edge_type", F.col("source_id").alias("src"), F.col("target_id").alias("dst")),
                                 J.splits.SplitOptions(relations=("associated_with",), eval_negatives=1.0))
    scorer = J.train_links(edges, nodes, links, ["associated_with"], hops=2, epochs=80, rate=1.0)
    rows = scorer(J.labelled(links, "train")).collect()
    mean = {label: np.mean([r["score"] for r in rows if r["label"] == label]) for label in (0, 1)}
    assert mean[1] > mean[0]
    assert {r["node_id"] for r in scorer.vectors.collect()} == {r["node_id"] for r in nodes.collect()}
    metrics = J.train_and_evaluate(edges, nodes, links, {"associated_with": "gene"}, per_positive=50, seeds=(13, 17), hops=0, epochs=3).collect()
    assert sorted(r["seed"] for r in metrics) == [13, 17]
    assert all(0 <= r["auroc"] <= 1 and r["num_positives"] > 0 for r in metrics)


def test_sums_of_few_tasks_are_those_of_the_shuffle(frame):
    rng = np.random.default_rng(8)
    rows = [(k % 3, rng.normal(size=4).tolist(), float(rng.integers(0, 2))) for k in range(90)]
    blocks = T._blocks(frame(rows, "fit int, features array<double>, label double").repartition(5))
    state = {1: rng.normal(size=5)}
    few, shuffled = T._sums(blocks, state, few=True), T._sums(blocks, state)
    assert few.keys() == shuffled.keys() == {0, 1, 2}
    assert all(np.allclose(few[f], shuffled[f], rtol=1e-12) for f in few) and few[0][-1] == 30
