import bisect
import random
import zlib

import numpy as np
import pytest
from data import documents, odd_rows
from tokenizers import Tokenizer

from graphrank.llm import mixing, packing
from graphrank.llm.queries import MIX, tokenizer_definition


def test_mix_meets_targets(spark):
    rows = odd_rows()
    mixed = mixing.mix(documents(spark, rows), keep=["doc_id", "source"], **MIX)
    got = mixed.collect()
    assert len(got) == len(rows)
    whole = sum(r["size"] for r in got)
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
        by_source.setdefault(r["row"]["source"], []).append(r)
    for members in by_source.values():
        assert abs(sum(r["taken"] for r in members) - members[0]["target"]) <= 1
        assert sum(r["size"] for r in members) == members[0]["source_size"]
    assert abs(sum(m[0]["target"] for m in by_source.values()) - 1.5 * whole) < 1
    assert mixed.collect() == got
    order = mixing.training_order(mixed).collect()
    assert len(order) == sum(-(-r["taken"] // r["size"]) for r in got if r["taken"])
    assert mixing.mix(documents(spark, []), keep=["doc_id"], **MIX).count() == 0


def test_position_inverts_demand(spark):
    frame = spark.sql("SELECT 100.0D AS target, 3.0D AS start, 1.0D AS end, 2.0D AS weight, id * 10.0D AS before FROM range(11)")
    for r in frame.withColumn("t", mixing.position_of(frame["before"])).collect():
        t = r["t"]
        assert abs((3 * t - t * t) / 2 * 100 - r["before"]) < 1e-9


@pytest.mark.parametrize("seed", range(60))
def test_plan_uses_every_piece_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 64, 300])
    histogram = {}
    for _ in range(draw.randint(0, 40)):
        histogram[draw.randint(1, capacity)] = draw.randint(1, draw.choice([2, 40, 900]))
    used, sequences = {}, 0
    for lengths, times in packing.plan(histogram, capacity):
        assert times > 0 and sum(lengths) <= capacity
        sequences += times
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    gaps = []  # best fit, longest first
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect.bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            bisect.insort(gaps, gap - length)
    assert sequences <= 1.02 * len(gaps) + 1


def test_exact_complements_first():
    assert packing.plan({7: 2, 3: 2}, 10) == [((7, 3), 2)]
    assert packing.plan({5: 1, 3: 1, 2: 1}, 10) == [((5, 3, 2), 1)]


def test_pieces_round_trip(spark):
    rows = [*odd_rows(), (50, "İ, it's <|endoftext|> naïve É. x y 'll", "aa", "s")]
    got = packing.pack(documents(spark, rows), tokenizer_definition(), capacity=64).collect()
    whole = Tokenizer.from_str(tokenizer_definition())
    expected = []
    for i, t, *_ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            expected.append((i is None, i or 0, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(documents(spark, []), tokenizer_definition()).count() == 0
