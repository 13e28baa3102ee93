from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from graphrank.operators import evaluate as E
from graphrank.operators import kge as K
from graphrank.operators import propagation as P
from graphrank.operators import scorers as R

TRIPLE = "head string, relation string, tail string"


@pytest.fixture(scope="module")
def train(frame):
    return frame([("D1", "r", "G1"), ("D1", "r", "G2"), ("D2", "r", "G2"), ("D2", "r", "G3")], TRIPLE)


def scores(df):
    return {(r.head, r.tail): r.score for r in df.collect()}


def test_popularity_and_centrality(frame, train):
    candidates = frame([("D1", "r", "G2"), ("D1", "r", "G3"), ("D1", "r", "new")], TRIPLE)
    assert scores(R.score_by_tail(candidates, R.popularity(train))) == {("D1", "G2"): 4.0, ("D1", "G3"): 2.0, ("D1", "new"): 0.0}
    central = scores(R.score_by_tail(candidates, R.centrality(train, 5)))
    assert 2.0 < central["D1", "G2"] < 3.0 and 1.0 < central["D1", "G3"] < 2.0 and central["D1", "new"] == 0.0


def test_kge_formulas(frame):
    entities = frame([("a", [1.0, 2.0]), ("b", [3.0, 5.0])], "node string, vector array<double>")
    relations = frame([("r", [0.5, -1.0])], "relation string, weight array<double>")
    pairs = frame([("a", "r", "b"), ("a", "r", "x"), ("a", "q", "b")], TRIPLE)
    want = {"TransE": -math.sqrt(1.5**2 + 4**2), "RotatE": -math.sqrt(1.5**2 + 4**2), "DistMult": 1.5 - 10.0, "ComplEx": 1.5 - 10.0 + 13.0}
    for model in R.KGE_MODELS:
        got = {(r.relation, r.tail): r.score for r in R.kge_scores(pairs, entities, relations, model).collect()}
        assert got["r", "b"] == pytest.approx(want[model]) and got["r", "x"] == 0.0 and got["q", "b"] == 0.0
    with pytest.raises(ValueError):
        R.kge_scores(pairs, entities, relations, "other")
    decoded = {(r.relation, r.tail): r.score for r in R.decode(pairs, entities, "dot").collect()}
    assert decoded["r", "b"] == 13.0 and decoded["r", "x"] == 0.0
    with pytest.raises(ValueError):
        R.decode(pairs, entities, "distmult")


def test_kge_fit_separates_and_stops_early(frame):
    rows = [(f"D{i}", "r", f"G{j}", int(i % 2 == j % 2)) for i in range(4) for j in range(4)]
    examples = frame(rows, TRIPLE + ", label int")
    fit = R.fit_kge(examples, dim=4, epochs=60, learning_rate=2.0)
    auc = E.auroc(R.kge_scores(examples, fit.entities, fit.relations, "DistMult")).first().auroc
    assert auc > 0.9
    values = iter([0.1, 0.5, 0.4, 0.3, 0.2])
    stopped = R.fit_kge(examples, dim=2, epochs=5, validate=lambda e, r: next(values), patience=2)
    assert stopped.best_epoch == 1 and len(stopped.history) == 4


def test_fitted_scorers_find_the_signal(frame):
    rows = [(f"D{i}", "r", f"G{j}", int((i < 3) == (j < 3))) for i in range(6) for j in range(6)]
    examples = frame(rows, TRIPLE + ", label int")
    vectors = frame([(f"{k}{i}", [1.0 if i < 3 else -1.0, 0.1 * i]) for k in "DG" for i in range(6)], "node_id string, vector array<double>")
    model = R.fit_logistic(R.link_features(examples, vectors))
    assert E.auroc(R.logistic_scores(model, examples, vectors)).first().auroc == 1.0
    nodes = vectors.withColumnRenamed("node_id", "node")
    # two hidden units cannot be relied on to learn "same side"; "tail on the first side" they must learn
    by_tail = examples.withColumn("label", F.col("tail").isin("G0", "G1", "G2").cast("int"))
    net = R.fit_perceptron(by_tail, nodes, 2, max_iter=60)
    assert E.auroc(R.perceptron_scores(net, by_tail, nodes)).first().auroc == 1.0
    positives = examples.where("label = 1")
    heads, tails = R.fit_factors(positives, rank=2, max_iter=5)
    assert E.auroc(R.factor_scores(examples, heads, tails)).first().auroc == 1.0
    unseen = frame([("nobody", "r", "G1")], TRIPLE)
    assert R.factor_scores(unseen, heads, tails).first().score == 0.0
    by_structure = R.structure_scores(positives, dim=2, iterations=10)
    assert E.auroc(by_structure(examples)).first().auroc == 1.0
    assert by_structure(unseen).count() == 1


def test_losses_weigh_relations_alike(frame):
    rows = [("a", 0.0, 1)] * 3 + [("b", 1000.0, 1), ("b", -1000.0, 1)]
    scored = frame(rows, "edge_type string, score double, label int")
    losses = {r.edge_type: r.loss for r in R.relation_losses(scored).collect()}
    assert losses["a"] == pytest.approx(math.log(2)) and losses["b"] == pytest.approx(500.0)
    assert R.multitask_loss(scored).first().loss == pytest.approx((math.log(2) + 500.0) / 2)


def test_propagation_by_hand(frame):
    typed = frame([("gene", "interacts", "gene", "a", "b"), ("gene", "interacts", "gene", "c", "b"), ("drug", "targets", "gene", "d", "b")],
                  "src_type string, relation string, dst_type string, src string, dst string")
    x = frame([("gene", "a", [1.0]), ("gene", "b", [10.0]), ("gene", "c", [3.0]), ("drug", "d", [5.0])],
              "node_type string, node_id string, x array<double>")
    def at_b(df):
        return {r.node_id: r.x[0] for r in df.collect()}["b"]
    assert at_b(P.relation_means(typed, x, 1)) == 10.0 + 2.0 + 5.0
    assert at_b(P.homogeneous_means(typed, x, 1)) == 10.0 + 3.0
    assert at_b(P.relational_average(typed, x, 1)) == (10.0 + 1 + 3 + 5) / 4
    assert at_b(P.relational_average(typed, x, 1, weights={"targets": 2.0})) == (10.0 + 1 + 3 + 10) / 4
    assert {r.node_id for r in P.relation_means(typed, x, 1, keep_self=False).collect()} == {"b"}


def test_row_scorer(frame, train):
    scorer = R.row_scorer(lambda head, relation, tail: tail.str[1:].astype("float64"))
    assert scores(scorer(train))["D2", "G3"] == 3.0
    assert "score" in scorer(train.withColumn("x", F.lit(1))).columns


def _by_hand(rows, dim, epochs, rate, start):
    """Mean gradients, one example after the other."""
    v = {k: list(x) for k, x in start.items()}
    for _ in range(epochs):
        sums, n = {k: [0.0] * dim for k in v}, dict.fromkeys(v, 0)
        for h, r, t, y in rows:
            x, w, z = v["E", h], v["R", r], v["E", t]
            e = 1 / (1 + math.exp(-sum(a * b * c for a, b, c in zip(x, w, z)))) - y
            for key, p, q in ((("E", h), w, z), (("E", t), x, w), (("R", r), x, z)):
                sums[key] = [s + e * a * b for s, a, b in zip(sums[key], p, q)]
                n[key] += 1
        v = {k: [a - rate * s / n[k] for a, s in zip(x, sums[k])] for k, x in v.items()}
    return v


def _vectors(fit):
    return {**{("E", r.node): r.vector for r in fit.entities.collect()}, **{("R", r.relation): r.weight for r in fit.relations.collect()}}


def test_kge_blocks_take_the_steps_of_the_definition(frame, monkeypatch):
    """Many blocks and parts, repeated rows, loops, nodes at both ends and rows without an end or label."""
    rows = [(f"D{i * i % 11}", "rq"[i % 2], f"G{i * 7 % 13}", i % 3 % 2) for i in range(60)] + [("G1", "r", "D1", 1), ("X", "q", "X", 0)] * 2
    odd = [(None, "r", "G1", 1), ("D1", "r", None, 0), ("D1", None, "G1", 1), ("Z", "r", "G1", None)]
    monkeypatch.setattr(K, "_BLOCK", 7)
    monkeypatch.setattr(K, "_PART", 9)
    examples = frame(rows + odd, TRIPLE + ", label int")
    start, done = (_vectors(R.fit_kge(examples, dim=3, epochs=n, learning_rate=2.0)) for n in (0, 3))
    want = _by_hand(rows, 3, 3, 2.0, start)
    assert start.keys() == done.keys() == want.keys() and len(want) > 20
    for key, x in want.items():
        assert list(done[key]) == pytest.approx(x, rel=1e-9)
    assert any(max(abs(a - b) for a, b in zip(start[k], done[k])) > 1e-3 for k in start)


def test_kge_keeps_two_rounds_and_the_best_on_disk(frame, spark):
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    seen = []
    examples = frame([("D1", "r", "G1", 1), ("D1", "r", "G2", 0)], TRIPLE + ", label int")

    def validate(entities, relations):
        seen.append(len(list(folder.glob("stored-*"))))
        return 1.0 if len(seen) == 2 else 0.0

    fit = R.fit_kge(examples, dim=2, epochs=30, validate=validate)
    assert fit.best_epoch == 1 and len(fit.history) == 10 and max(seen) - min(seen) <= 1
    assert fit.entities.count() == 3


def test_registered_kge_fits_are_whole(frame, monkeypatch):
    """Every epoch and component of the fit is asked for, and early stopping can end it before its last epoch."""
    from inspect import signature

    from graphrank.catalog import scoring as C

    asked = []
    links = frame([("D1", "r", "G1", 1)], TRIPLE + ", label int")
    monkeypatch.setattr(C, "labelled_links", lambda s: links)
    monkeypatch.setattr(C, "_examples", lambda rows, split: rows)
    real = signature(R.fit_kge)

    def fit(*args, **options):
        bound = real.bind(*args, **options)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return K.KgeFit(frame([("D1", [1.0])], "node string, vector array<double>"), frame([("r", [1.0])], "relation string, weight array<double>"), 0, ())

    monkeypatch.setattr(R, "fit_kge", fit)
    for name in ("fitted_kge_scores", "early_stopped_kge"):
        getattr(C, name)(None)
    assert [(a["dim"], a["epochs"]) for a in asked] == [(16, 100)] * 2
    assert asked[1]["validate"] is not None and asked[1]["patience"] == 8
