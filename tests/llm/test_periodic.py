"""Runs against a scan of every period, and the digests against a plain second computation."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
from data import documents, odd_rows

from graphrank.llm import periodic

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    n, shortest = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                shortest.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in shortest.items()), key=lambda r: (r[0], r[2]))


def drawn(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 50, 1000])) for _ in range(rng.randint(0, 400))]
    for _ in range(rng.randint(0, 3) if words else 0):
        q = rng.randint(1, 90)
        base = [rng.randrange(rng.choice([2, 5, 1000])) for _ in range(q)]
        at = rng.randrange(len(words))
        words[at:at] = (base * 8)[: rng.randint(3 * q, 7 * q)]
    return words


def test_runs_of_many_texts():
    rng = random.Random(11)
    for _ in range(60):
        texts = [drawn(rng) for _ in range(rng.randint(1, 6))]
        got = periodic.find_runs(np.array([w for t in texts for w in t], dtype=np.int64), np.array([len(t) for t in texts]))
        assert got == [brute(t) for t in texts]


def test_one_very_long_text_is_fast():
    begin = time.time()
    assert periodic.find_runs(np.zeros(1 << 19, dtype=np.int64), np.array([1 << 19])) == [[(0, 1 << 19, 1)]]
    long_period = np.tile(np.arange(40_000), 9)
    assert periodic.find_runs(long_period, np.array([len(long_period)])) == [[(0, 360_000, 40_000)]]
    rng = np.random.default_rng(1)
    periodic.find_runs(rng.integers(0, 2, 1 << 19), np.array([1 << 19]))
    assert time.time() - begin < 20


def want(doc_id, text, planted):
    words = WORD.findall(text or "")
    if planted and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)), kept


def test_rows_against_brute_force(spark):
    rows = odd_rows() + [(100 + k, " ".join(f"w{(i * i) % (k + 3)}" for i in range(60 + k)), "aa", "s0") for k in range(60)]
    rows += [(200, "a a a a a a", "aa", "s"), (201, "a a a a a", "aa", "s"), (202, "\x0ba\x1fb c \x0c" * 9, "aa", "s"), (None, "x y " * 30, None, None)]
    for planted in (False, True):
        got = periodic.periodic_runs(documents(spark, rows), planted=planted, collapsed=True).collect()
        expected = [want(i, t, planted) for i, t, *_ in rows]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

        def key(r):
            return tuple((v is None, v) if not isinstance(v, str) else v for v in r)

        assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted((r for r, _ in expected), key=key)
        assert sorted(r["collapsed"] for r in got) == sorted(text for _, text in expected)
    assert any(r[1] for r, _ in expected)


def test_empty_table(spark):
    assert periodic.periodic_runs(documents(spark, [])).count() == 0


def test_ties_of_the_most_periodic():
    assert periodic.most_periodic([(5, 8, 2), (0, 4, 1), (9, 12, 3)]) == (5, 8, 2)
    assert periodic.most_periodic([]) is None
