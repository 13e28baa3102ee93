from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphrank.operators import negatives as N
from graphrank.operators import splits as S
from graphrank.plans.lineage import materialize
from graphrank.sources import tables as T


@pytest.fixture(scope="module")
def links(frame):
    rows = [("associated_with", f"D{i}", f"G{j}") for i in range(12) for j in range(20) if (i * 7 + j * 3) % 5 == 0]
    rows += [("targets", f"C{i}", f"G{(i * 3) % 20}") for i in range(20)]
    rows += [("participates_in", f"G{i}", f"R{i % 2}") for i in range(20)]
    return frame(rows, "edge_type string, src string, dst string")


OPTIONS = S.SplitOptions(seed=7, num_val=0.2, num_test=0.2, disjoint_train_ratio=0.5, eval_negatives=2.0)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_sizes_follow_the_ratios():
    assert S.count_from_ratio(0.25, 10) == 2 and S.count_from_ratio(0.35, 10) == 4 and S.count_from_ratio(99, 10) == 10
    assert S.split_sizes(1, S.SplitOptions()) == {"test": 0, "val": 0, "train": 1, "message": 0}
    assert S.split_sizes(2, S.SplitOptions(disjoint_train_ratio=1.0)) == {"test": 0, "val": 0, "train": 1, "message": 1}
    sizes = S.split_sizes(100, S.SplitOptions())
    assert sizes == {"test": 10, "val": 9, "train": 24, "message": 57}


@pytest.mark.parametrize("strategy", N.STRATEGIES)
def test_no_leakage_and_same_rows_under_any_partitioning(links, strategy):
    options = S.SplitOptions(**{**OPTIONS.__dict__, "negative_strategy": strategy})
    first = S.split_links(links, options)
    rows = rows_of(first)
    assert rows == rows_of(S.split_links(links.repartition(5, "dst"), options))
    assert {r.violations for r in S.audit_splits(first).collect()} == {0}
    positives = {r[:3] for r in rows if r[5] == 1}
    assert positives == rows_of(links)
    negatives = [r[:3] for r in rows if r[5] == 0]
    assert len(negatives) == len(set(negatives)) and not set(negatives) & positives


def test_splits_are_stored_and_read_back(spark, links, tmp_path):
    made = S.split_links(links, OPTIONS)
    T.save_splits(made, S.split_metadata(OPTIONS, made), str(tmp_path))
    stored, metadata = T.load_splits(spark, str(tmp_path))
    assert rows_of(stored.select(*made.columns)) == rows_of(made)
    assert {r.seed for r in metadata.collect()} == {7}
    message = S.message_links(stored)
    assert rows_of(message) == {r[:3] for r in rows_of(made) if r[4] == "message"}


@pytest.fixture(scope="module")
def square(frame):
    """4 x 4 nodes, three positives and one used pair."""
    ends = frame([("r", f"{i}") for i in range(4)], "edge_type string, id string")
    taken = frame([("r", "0", "0"), ("r", "0", "1"), ("r", "1", "1"), ("r", "2", "2")], "edge_type string, src string, dst string")
    degrees = frame([("r", side, f"{i}", 5 - i) for i in range(4) for side in ("src", "dst")], "edge_type string, side string, id string, degree int")
    hard = frame([("r", "0", "2"), ("r", "0", "3"), ("r", "1", "2"), ("r", "0", "1")], "edge_type string, src string, dst string")
    return ends, taken, degrees, hard


def test_strategies_avoid_forbidden_pairs(square):
    ends, taken, degrees, hard = square
    blocked = rows_of(taken)
    everything = {("r", f"{i}", f"{j}") for i in range(4) for j in range(4)} - blocked
    random = rows_of(N.sample_negatives(ends, ends, taken, {"r": 4}, 1))
    assert len(random) == 4 and random <= everything
    assert rows_of(N.sample_negatives(ends, ends, taken, {"r": 400}, 1)) == everything
    best = rows_of(N.sample_negatives(ends, ends, taken, {"r": 3}, 1, strategy="degree_matched", degrees=degrees))
    total = {p: 10 - int(p[1]) - int(p[2]) for p in everything}
    assert sorted(total[p] for p in best) == sorted(sorted(total.values())[-3:])
    assert rows_of(N.sample_negatives(ends, ends, taken, {"r": 400}, 1, strategy="degree_matched", degrees=degrees)) == everything
    picked = rows_of(N.sample_negatives(ends, ends, taken, {"r": 2}, 1, strategy="hard", hard_pairs=hard))
    assert len(picked) == 2 and picked <= rows_of(hard) - blocked
    topped = rows_of(N.sample_negatives(ends, ends, taken, {"r": 5}, 1, strategy="hard", hard_pairs=hard, prefer_hard=True))
    assert len(topped) == 5 and rows_of(hard) - blocked <= topped
    assert len(rows_of(N.sample_negatives(ends, ends, taken, {"r": 5}, 1, strategy="hard", hard_pairs=hard))) == 5
    with pytest.raises(ValueError):
        N.sample_negatives(ends, ends, taken, {"r": 1}, 1, strategy="unknown")


def test_sparse_space_is_drawn_not_enumerated(frame):
    ends = frame([("r", f"n{i:04d}") for i in range(900)], "edge_type string, id string")
    taken = frame([("r", f"n{i:04d}", f"n{i:04d}") for i in range(900)], "edge_type string, src string, dst string")
    got = rows_of(N.sample_negatives(ends, ends, taken, {"r": 3000}, 5))
    assert len(got) == 3000 and all(r[1] != r[2] for r in got)
    heads = {r[1] for r in got}
    assert len(heads) > 800  # spread over all sources
    assert got == rows_of(N.sample_negatives(ends.repartition(9), ends, taken, {"r": 3000}, 5))


def test_message_graph_keeps_other_relations(frame, links):
    parts = S.partition_links(links, OPTIONS)
    edges = links.select(F.col("src").alias("source_id"), "edge_type", F.col("dst").alias("target_id")).unionByName(
        frame([("G1", "interacts", "G2")], "source_id string, edge_type string, target_id string"))
    kept = S.message_graph(edges, parts)
    assert kept.where("edge_type = 'interacts'").count() == 1
    assert kept.count() == 1 + parts.where("role = 'message'").count()


def test_larger_samples_begin_with_smaller_ones(frame):
    ends = [("r", f"n{i}") for i in range(12)]
    heads = frame(ends, "edge_type string, id string")
    blocked = frame([("r", f"n{i}", f"n{i}") for i in range(12)], "edge_type string, src string, dst string")
    before = set()
    for n in (1, 20, 35, 36, 37, 131, 132, 500):
        got = {tuple(r) for r in N.sample_negatives(heads, heads, blocked, {"r": n}, 13).collect()}
        assert len(got) == min(n, 132) and before <= got and all(s != d for _, s, d in got)
        before = got


@pytest.mark.parametrize(("heads", "tails", "n"), [(300, 400, 400), (3000, 40, 3000), (40, 25, 500)])
def test_draws_are_spread_like_chance(frame, heads, tails, n):
    """Counts per end have the spread of independent draws, neither a lattice nor clusters."""
    sides = [frame([("r", f"{i}") for i in range(size)], "edge_type string, id string") for size in (heads, tails)]
    none = frame([], "edge_type string, src string, dst string")
    ratios = {1: [], 2: []}
    for seed in range(4):
        got = N.sample_negatives(*sides, none, {"r": n}, seed).collect()
        assert len({tuple(r) for r in got}) == n
        for end, size in ((1, heads), (2, tails)):
            counts = Counter(r[end] for r in got)
            mean = n / size
            spread = sum((counts[f"{i}"] - mean) ** 2 for i in range(size)) / size
            other = heads * tails / size
            chance = mean * (1 - 1 / size) * (heads * tails - n) / (heads * tails - 1)  # without replacement
            assert other >= 1
            ratios[end].append(spread / chance)
    for end, size in ((1, heads), (2, tails)):
        mean_ratio = sum(ratios[end]) / len(ratios[end])
        assert abs(mean_ratio - 1) < 5 * (2 / (size * len(ratios[end]))) ** 0.5


def test_dense_space_is_walked_on(frame):
    """Nearly all pairs are forbidden, and all that is left is found."""
    ends = frame([("r", f"{i}") for i in range(60)], "edge_type string, id string")
    free = {(f"{i}", f"{(7 * i) % 60}") for i in range(60)}
    taken = frame([("r", f"{i}", f"{j}") for i in range(60) for j in range(60) if (f"{i}", f"{j}") not in free], "edge_type string, src string, dst string")
    assert {tuple(r)[1:] for r in N.sample_negatives(ends, ends, taken, {"r": 100}, 3).collect()} == free
    some = {tuple(r)[1:] for r in N.sample_negatives(ends, ends, taken, {"r": 7}, 3).collect()}
    assert len(some) == 7 and some <= free


@pytest.mark.parametrize("n", [1, 5, 40, 200, 777, 10_000])
def test_degree_sums_against_a_full_sort(frame, n):
    rng = random.Random(n)
    heads = {f"h{i}": rng.choice([1, 1, 1, 2, 3, 50]) for i in range(30)}
    tails = {f"t{i}": rng.choice([0, 1, 1, 4, 9]) for i in range(40)}
    blocked = {(rng.choice(list(heads)), rng.choice(list(tails))) for _ in range(300)}
    degrees = [("r", "src", k, d) for k, d in heads.items()] + [("r", "dst", k, d) for k, d in tails.items()]

    def ranks(side, nodes):
        order = sorted(nodes, key=lambda k: (-nodes[k], hashlib.md5(f"3|{side}|r|{k}".encode()).hexdigest()))
        return {k: i + 1 for i, k in enumerate(order)}

    row, col = ranks("src", heads), ranks("dst", tails)
    pairs = [(h, t) for h in heads for t in tails if (h, t) not in blocked]
    pairs.sort(key=lambda p: (-heads[p[0]] - tails[p[1]], row[p[0]] * col[p[1]], hashlib.md5(f"3|s|r|{p[0]}|{p[1]}".encode()).hexdigest()))
    got = N.sample_negatives(
        frame([("r", h) for h in heads], "edge_type string, id string"), frame([("r", t) for t in tails], "edge_type string, id string"),
        frame([("r", *p) for p in blocked], "edge_type string, src string, dst string"), {"r": n}, 3, "s", "degree_matched",
        frame(degrees, "edge_type string, side string, id string, degree int"))
    assert {tuple(r)[1:] for r in got.collect()} == set(pairs[:n])


def test_two_step_pairs_are_all_found_and_weighted_by_ways(frame):
    """A hub in the middle, forbidden pairs, few ways left; a sample begins with the smaller one."""
    rng = random.Random(2)
    links = {(f"d{i}", "hub") for i in range(30)} | {(f"d{rng.randrange(30)}", f"g{rng.randrange(12)}") for _ in range(60)}
    near = {("hub", f"g{i}") for i in range(12)} | {(f"g{rng.randrange(12)}", f"g{rng.randrange(12)}") for _ in range(30)} | {("hub", "off")}
    ways = [(s, b) for s, m in links for a, b in near if a == m and b != "off"]
    possible = set(ways) - links
    both = (frame([("r", *p) for p in links], "edge_type string, src string, dst string"), frame(list(near), "a string, b string"))
    targets = frame([(f"g{i}",) for i in range(12)], "id string")
    before = set()
    for n in (1, 10, 60, 10_000):
        got = {tuple(r) for r in N.sample_hard_pairs(*both, both[0], n, 5, targets=targets).collect()}
        assert len(got) == min(n, len(possible)) and before <= got <= possible
        before = got
    none = frame([], "a string, b string")
    assert N.sample_hard_pairs(both[0], none, both[0], 5, 5).count() == 0


def test_a_step_of_the_permutation_is_computed_once(spark, capsys):
    from graphrank.operators import negatives

    visited = negatives._visited(spark, "r", (70, 90), (0, 70 * 90), 13, "test")
    visited.where("_s >= 0").explain()
    assert capsys.readouterr().out.count("md5") <= negatives.ROUNDS
    left, right = negatives.halves(70 * 90)
    rows = negatives._visited(spark, "r", (70, 90), (0, left * right), 13, "test").collect()
    assert sorted((r["_s"], r["_d"]) for r in rows) == [(s, d) for s in range(70) for d in range(90)]


def test_parts_are_cut_by_counting_and_copies_keep_their_number(frame, capsys):
    """Ranks of the hash decide, copies of a link are numbered, and no link is sorted into its place."""
    rows = [("a", f"x{i % 9}", f"y{i % 11}") for i in range(400)] + [("b", "p", "q")] * 30 + [("c", "u", None), (None, "u", "v")]
    options = S.SplitOptions(seed=5, num_val=0.3, num_test=0.25, disjoint_train_ratio=0.5)
    parts = S.partition_links(frame(rows, "edge_type string, src string, dst string").repartition(5), options)
    parts.explain()
    assert "_row_pos" not in capsys.readouterr().out
    got = Counter(tuple(r) for r in parts.collect())
    want = Counter()
    for relation in "abc":
        own = sorted((r for r in rows if r[0] == relation), key=lambda r: hashlib.md5("|".join(["5", *[v for v in r if v is not None]]).encode()).hexdigest())
        sizes = S.split_sizes(len(own), options)
        names = [("test", "supervision")] * sizes["test"] + [("val", "supervision")] * sizes["val"]
        names += [("train", "supervision")] * sizes["train"] + [("train", "message")] * sizes["message"]
        want.update((*r, *name) for r, name in zip(own, names, strict=True))
    assert got == want


@pytest.mark.parametrize("wanted", [20, 330, 5000])
def test_hard_pairs_are_not_stored_whole(frame, monkeypatch, wanted):
    """The pairs of lowest hash, as a sort of all pairs gives them; too few are topped up from all others."""
    stored = []

    def recorded(df):
        out = materialize(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(N, "materialize", recorded)
    pairs = [("r", f"h{i}", f"t{j}") for i in range(40) for j in range(50)]
    hard, blocked = pairs[::2], set(pairs[::6])
    ends = [frame([("r", v) for v in sorted({p[k] for p in pairs})], "edge_type string, id string") for k in (1, 2)]
    schema = "edge_type string, src string, dst string"
    drawn = rows_of(N.sample_negatives(*ends, frame(sorted(blocked), schema), {"r": wanted}, 3, "s", "hard", hard_pairs=frame(hard * 3, schema)))
    ranked = sorted(set(hard) - blocked, key=lambda p: hashlib.md5("|".join(["3", "s", *p]).encode()).hexdigest())
    if wanted <= len(ranked):
        assert drawn == set(ranked[:wanted])
    else:
        assert drawn == set(pairs) - blocked
    if wanted == 20:
        assert max(stored) < len(ranked) / 2
