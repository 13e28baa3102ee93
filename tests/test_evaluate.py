from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from graphrank.operators import evaluate as E
from graphrank.operators import scorers as R

TRIPLE = "head string, relation string, tail string"


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else math.nan


def brute_ap(rows):
    ordered = sorted(rows, key=lambda r: (-r[1], -r[0]))
    hits, total = 0, 0.0
    for i, (y, _) in enumerate(ordered, 1):
        hits += y
        total += y * hits / i
    return total / hits if hits else math.nan


def test_hand_values(frame):
    df = frame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    assert E.auroc(df).first().auroc == 0.75
    assert E.auprc(df).first().auprc == pytest.approx(0.8333333)
    ranks = frame([(1.0,), (3.0,), (10.0,)], "rank double")
    row = E.ranking_metrics(ranks).first()
    assert row.hits_at_3 == pytest.approx(2 / 3) and row.mrr == pytest.approx((1 + 1 / 3 + 1 / 10) / 3)
    one_class = frame([(1, 0.5)], "label int, score double")
    assert math.isnan(E.auroc(one_class).first().auroc)
    assert math.isnan(E.auprc(one_class.withColumn("label", F.lit(0))).first().auprc)


def test_ties_against_brute_force(frame):
    rng = random.Random(4)
    rows = [(f"k{k}", int(rng.random() < 0.4), float(rng.randint(0, 6))) for k in range(5) for _ in range(rng.randint(2, 40))]
    df = frame(rows, "k string, label int, score double").repartition(3)
    auc = {r.k: r.auroc for r in E.auroc(df, ["k"]).collect()}
    ap = {r.k: r.auprc for r in E.auprc(df, ["k"]).collect()}
    for k in auc:
        own = [(y, s) for g, y, s in rows if g == k]
        assert auc[k] == pytest.approx(brute_auc(own), nan_ok=True) and ap[k] == pytest.approx(brute_ap(own), nan_ok=True)


def test_one_tie_group_of_thousands(frame):
    rows = [(0, 2.0)] * 3 + [(1, 1.0)] * 3000 + [(0, 1.0)] * 500 + [(1, 0.0)] * 2
    assert E.auprc(frame(rows, "label int, score double")).first().auprc == pytest.approx(brute_ap(rows), rel=1e-12)


def test_filtered_ranking_removes_other_known_tails(frame):
    scores = frame([("D1", "r", "G1", 0.8), ("D1", "r", "G2", 0.9), ("D1", "r", "G3", 0.1)], TRIPLE + ", score double")
    true = frame([("D1", "r", "G1")], TRIPLE)
    known = frame([("D1", "r", "G1"), ("D1", "r", "G2")], TRIPLE)
    assert E.filtered_ranks(scores, true, known, filtered=False).first()["rank"] == 2.0
    assert E.filtered_ranks(scores, true, known).first()["rank"] == 1.0
    with pytest.raises(KeyError):
        E.filtered_ranks(scores, frame([("D1", "r", "absent")], TRIPLE), known)


def test_ranks_and_metrics_against_brute_force(frame):
    rng = random.Random(8)
    cand = {(f"h{rng.randint(0, 3)}", "r", f"t{rng.randint(0, 40):02d}") for _ in range(200)}
    score = {c: float(rng.randint(0, 8)) for c in cand}
    positives = {c for c in sorted(cand) if rng.random() < 0.2}
    known = {c for c in sorted(positives) if rng.random() < 0.8} | {c for c in sorted(cand) if rng.random() < 0.2}

    def rank(c, filtered):
        others = [d for d in cand if d[0] == c[0] and d != c and not (filtered and d in known)]
        return 1 + sum(score[d] > score[c] for d in others) + 0.5 * sum(score[d] == score[c] for d in others)

    scored = frame([(*c, int(c in positives), score[c]) for c in cand], TRIPLE + ", label int, score double").withColumn("seed", F.lit(1))
    known_df, plain = frame(sorted(known), TRIPLE), scored.select("head", "relation", "tail", "score")
    for filtered in (True, False):
        got = E.filtered_ranks(plain, frame(sorted(positives), TRIPLE), known_df, filtered=filtered)
        assert {(r.head, r.relation, r.tail): r["rank"] for r in got.collect()} == {c: rank(c, filtered) for c in positives}
    row = E.evaluate_scores(scored, known_df).first()
    for name, flag in (("raw", False), ("filtered", True)):
        ranks = [rank(c, flag) for c in positives]
        assert row[f"{name}_mrr"] == pytest.approx(sum(1 / x for x in ranks) / len(ranks))
        assert row[f"{name}_hits_at_3"] == pytest.approx(sum(x <= 3 for x in ranks) / len(ranks))
    assert row.auprc == pytest.approx(brute_ap([(int(c in positives), score[c]) for c in cand]))


def test_all_open_tails_when_fewer_than_asked(frame):
    positives = frame([("D1", "r", "G1")], TRIPLE)
    known = frame([("D1", "r", "G1"), ("D1", "r", "G2")], TRIPLE)
    tails = frame([("r", f"G{i}") for i in range(1, 5)], "relation string, tail string")
    got = E.sample_tails(positives, known, tails, 1000)
    assert {r.tail for r in got.collect()} == {"G3", "G4"}
    values = {"G1": 0.8, "G2": 0.9, "G3": 0.2, "G4": 0.1}
    scorer = R.row_scorer(lambda h, r, t: t.map(values))
    row = E.evaluate_model(scorer, positives, known, tails).first()
    assert row.num_negatives == 2 and row.filtered_mrr == 1.0


@pytest.mark.parametrize("per_positive", [3, 10, 200])
def test_samples_are_exact_in_number_when_most_tails_are_known(frame, per_positive):
    """One head knows nearly all tails: its walk has to be lengthened."""
    tails = [f"t{i:03d}" for i in range(120)]
    known = [("hot", "r", t) for t in tails[:112]] + [("cold", "r", tails[0]), ("cold", "r", tails[1])]
    positives = [("hot", "r", tails[0]), ("hot", "r", tails[5]), ("cold", "r", tails[0]), ("new", "r", tails[7])]
    args = (frame(positives, TRIPLE), frame(known, TRIPLE), frame([("r", t) for t in tails], "relation string, tail string"), per_positive, (1, 2))
    rows = [tuple(r) for r in E.sample_tails(*args).collect()]
    assert len(rows) == len(set(rows))
    for seed in (1, 2):
        for head, _, true in positives:
            got = {r[4] for r in rows if r[0] == seed and r[1] == head and r[3] == true}
            open_ = {t for t in tails if (head, "r", t) not in known and t != true}
            assert got <= open_ and len(got) == min(per_positive, len(open_))
    again = E.sample_tails(args[0].repartition(3), *args[1:])
    assert {tuple(r) for r in again.collect()} == set(rows)


def test_seed_summary_and_significance(frame):
    rows = [("a", s, "AUPRC", s / 100) for s in (11, 13, 17, 19, 23)] + [("b", s, "AUPRC", 0.2) for s in (11, 13)] + [("c", 11, "AUPRC", 0.5)]
    metrics = frame(rows, "arm string, seed int, metric string, value double")
    summary = {r.arm: r for r in E.summarize_seeds(metrics, ["arm"]).collect()}
    assert summary["a"].ci95 == pytest.approx(1.96 * summary["a"]["std"] / math.sqrt(5)) and summary["c"]["std"] == 0.0
    reference = frame([(s, "AUPRC", 0.1) for s in (11, 13, 17, 19, 23)], "seed int, metric string, value double")
    tests = {r.arm: r for r in E.paired_significance(metrics, reference).collect()}
    assert tests["a"].p_value == pytest.approx(math.erfc(abs(tests["a"].statistic) / math.sqrt(2)), rel=1e-9)
    assert tests["b"].statistic == math.inf and tests["b"].p_value == 0.0
    assert tests["c"].status == "insufficient_pairs" and tests["c"].p_value is None
    with pytest.raises(ValueError):
        E.require_seeds(metrics, "arm")


def test_erfc_is_accurate(frame):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 2.9999, 3.0, 4.0, 6.0, 10.0, 20.0]
    got = frame([(x,) for x in xs], "x double").select("x", E.erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-9) for r in got)


def test_keys_without_positives_and_odd_scores(frame):
    schema = "seed int, head string, relation string, tail string, label int, score double"
    rows = [(1, "a", "r", "x", 1, 0.5), (1, "a", "r", "y", 0, float("nan")), (1, "a", "r", "z", 0, None), (2, "a", "r", "y", 0, 0.1)]
    known = frame([("a", "r", "x")], "head string, relation string, tail string")
    got = {r["seed"]: r for r in E.evaluate_scores(frame(rows, schema), known).collect()}
    assert got[1]["auroc"] == 1.0 and got[1]["filtered_mrr"] == 1.0
    assert got[2]["num_positives"] == 0 and got[2]["filtered_mrr"] != got[2]["filtered_mrr"]
    one, = E.evaluate_scores(frame(rows[:3], schema), known, ()).collect()
    assert one["raw_mrr"] == 1.0 and one["num_negatives"] == 2


def test_walks_in_rows_and_walks_by_join_draw_the_same_tails(frame):
    rng = random.Random(8)
    links = sorted({(f"D{rng.randint(0, 9)}", "r", f"G{rng.randint(0, 60)}") for _ in range(200)} | {("D1", "r", f"G{i}") for i in range(58)})
    known = frame(links, TRIPLE)
    positives = frame([*rng.sample(links, 40), ("D1", "r", "G60"), ("D2", "r", "elsewhere")], TRIPLE)
    tails = frame([("r", f"G{i}") for i in range(61)], "relation string, tail string")
    drawn = [{tuple(r) for r in E.sample_tails(positives, known, tails, 7, (1, 2), held).collect()} for held in (0, 12, E.HELD)]
    assert drawn[0] == drawn[1] == drawn[2]
    assert not {(h, r, t) for _, h, r, _, t in drawn[0]} & set(links)
    assert {x[2:] for x in ((s, h, r, t) for s, h, r, t, _ in drawn[0])} <= {("r", t) for _, _, t in links} | {("r", "G60"), ("r", "elsewhere")}


def test_sampled_tails_are_merged_and_scored_where_they_are(spark, frame, capsys):
    links = [(f"D{i % 7}", "r", f"G{i}") for i in range(60)]
    known, tails = frame(links, TRIPLE), frame([("r", f"G{i}") for i in range(60)], "relation string, tail string")
    positives = known.limit(20)
    candidates = E.candidate_triples(positives, E.sample_tails(positives, known, tails, 5, (1, 2)), (1, 2), known)
    candidates.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(seed" not in plan and "hashpartitioning(head" in plan
    rows = candidates.collect()
    assert all(r["known"] == ((r["head"], "r", r["tail"]) in set(links)) for r in rows)
    plain = E.evaluate_scores(candidates.drop("known").withColumn("score", F.length("tail")), known)
    flagged = E.evaluate_scores(candidates.withColumn("score", F.length("tail")), known)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, flagged.collect()))


def test_areas_of_all_keys_come_from_one_pass(frame, monkeypatch):
    """Equal to the measures on their own; a key that is null has no row, one without positives has no area."""
    rows = [(k, "d", "r", f"g{i}", (i * 7 + k) % 3 % 2 if k < 3 else 0, float(i * 5 % 7)) for k in (1, 2, 3) for i in range(20)]
    rows.append((None, "d", "r", "g0", 1, 1.0))
    scored = frame(rows, "seed int, head string, relation string, tail string, label int, score double")
    want = {r.seed: (r.auroc, r.auprc) for r in E.auroc(scored, ["seed"]).join(E.auprc(scored, ["seed"]), "seed").collect()}
    calls, real = [], E.with_running_sums
    monkeypatch.setattr(E, "with_running_sums", lambda *a: calls.append(1) or real(*a))
    got = {r.seed: (r.auroc, r.auprc) for r in E.evaluate_scores(scored, scored.where("false"), ["seed"]).collect()}
    assert len(calls) == 1 and got.keys() == {1, 2, 3}
    for seed in (1, 2):
        assert got[seed] == pytest.approx(want[seed], abs=1e-12)
    assert all(math.isnan(v) for v in got[3])


def test_walks_stay_among_the_tails_of_their_relation(frame):
    """Tails of all relations are numbered in one row; a tail of two relations has a number in each, one of none has none."""
    tails = frame([("q", f"x{i}") for i in range(5)] + [("r", f"y{i}") for i in range(4)] + [("r", "x0"), (None, "z")], "relation string, tail string")
    positives = frame([("d", "q", "x1"), ("d", "r", "y1"), ("e", "r", "x0"), ("e", None, "z")], "head string, relation string, tail string")
    plans = E.sample_tails(positives, positives, tails, 50, (13, 17))
    got = {}
    for r in plans.collect():
        got.setdefault((r.seed, r.head, r.relation), []).append(r.tail)
    for seed in (13, 17):
        assert sorted(got[seed, "d", "q"]) == ["x0", "x2", "x3", "x4"]
        assert sorted(got[seed, "d", "r"]) == ["x0", "y0", "y2", "y3"]
        assert sorted(got[seed, "e", "r"]) == ["y0", "y1", "y2", "y3"]
    assert len(got) == 6
    joins = [line for line in plans._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (_row" in line]
    assert len(joins) == 1
