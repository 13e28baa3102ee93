import random
import re

import pytest
from data import documents, odd_rows, prose

from graphrank.llm import jaccard
from graphrank.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    """doc_id -> (set size, smallest id of its component)."""
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    name = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * len(sets[a] | sets[b]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = {i: low if n == high else n for i, n in name.items()}
    return {i: (len(sets[i]), name[i]) for i in ids}


def edited(text, seed, edits):
    words, draw = text.split(), random.Random(seed)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{seed}x{draw.random()}"
    return " ".join(words)


@pytest.mark.parametrize("small", [64, 3])
def test_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    base = prose(77, 120)
    passage = prose(78, 60)
    rows = [r for r in odd_rows() if r[0] is not None]
    rows += [(200 + i, edited(base, i, i % 4), "aa", "s") for i in range(40)]
    rows += [(300 + i, passage + prose(300 + i, 12 + i), "aa", "s") for i in range(25)]
    rows += [(400 + i, base.upper(), "aa", "s") for i in range(5)]
    rule = jaccard.Rule(size=4, percent=85, frequent=6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.component_ids(documents(spark, rows), rule).collect()}
    assert got == brute(rows, 4, 85)


def test_representatives_and_empty_table(spark):
    docs = documents(spark, odd_rows())
    rows = jaccard.representatives(docs, jaccard.Rule(5, 80))
    assert rows.columns == docs.columns
    ids = [r["doc_id"] for r in rows.collect()]
    assert ids.count(4) == 1 and 37 not in ids and 38 not in ids
    assert jaccard.component_ids(documents(spark, [])).count() == 0


def test_null_ids_alone(spark):
    rows = jaccard.component_ids(documents(spark, [(None, "a b c d e", "aa", "s"), (None, None, "aa", "s")])).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in rows) == [(0, None), (2, None)]


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in rows} == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100}


def test_each_text_of_null_and_repeated_ids_stays(spark):
    same = prose(1, 60)
    rows = [(None, prose(k, 60), "aa", "s") for k in range(10, 16)] + [(None, prose(10, 60), "aa", "s")]
    rows += [(5, same, "aa", "s"), (5, same, "aa", "s"), (7, same + " end", "aa", "s"), (None, same, "aa", "s")]
    rows += [(7, prose(k, 60), "aa", "s") for k in range(20, 25)] + [(None, None, "aa", "s"), (None, "", "aa", "s")]
    got = jaccard.representatives(documents(spark, rows), jaccard.Rule(size=5, percent=80)).collect()
    want = [(None, prose(k, 60)) for k in range(10, 16)] + [(5, same)] + [(7, prose(k, 60)) for k in range(20, 25)] + [(None, None), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
