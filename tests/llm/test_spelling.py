"""Neighbours, forms and roots against a comparison of all words of a small table."""

import random
import re
import zlib
from collections import Counter

from data import documents, odd_rows

from graphrank.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, slips):
    seen = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if slips and doc_id is not None and h % slips == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(seen, factor):
    out = {}
    for word, n in seen.items():
        around = [w for w in seen if near(w, word)]
        best = min(around, key=lambda w: (-seen[w], w), default=None)
        form = best if best is not None and seen[best] >= factor * n else None
        out[word] = (form, n, len(around), seen.get(form))
    full = {}
    for word, (form, *rest) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        full[word] = (form, root, *rest)
    return full


def found(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_table_against_all_pairs(spark):
    rng = random.Random(4)
    seen = {}
    for _ in range(40):
        word = "".join(rng.choice("abéÿ×") for _ in range(rng.randint(6, 9)))
        seen[word] = rng.randint(5, 40)
        for _ in range(12):  # edits of edits, with many equal letters in a row
            at = rng.randrange(len(word))
            kind = rng.randrange(3)
            letter = rng.choice("abéÿ×")
            word = word[:at] + ("" if kind == 0 else letter) + word[at + (kind != 1) :]
            if len(word) >= 6:
                seen.setdefault(word, rng.choice([5, 6, 30, 200, 1000, 6000]))
    words = spark.createDataFrame(list(seen.items()), "word string, n long")
    assert found(spelling.variants(words)) == brute(seen, 5)


def test_documents_slips_and_odd_rows(spark):
    words = ["banana", "Bananas", "baanana", "Éclairé", "éclairé", "strasse", "straße", "x" * 40, "x" * 41, "short"]
    rng = random.Random(9)
    rows = odd_rows() + [(1000 + k, " ".join(rng.choice(words) + rng.choice(["", ".", "1", "\n"]) for _ in range(60)), "aa", "s") for k in range(80)]
    rows += [(None, "banan banana banana-banana " * 3, None, None)] * 2
    for slips in (None, 7):
        seen = counts(rows, slips)
        table = spelling.word_counts(documents(spark, rows), slips=slips)
        assert {r["word"]: r["n"] for r in table.collect()} == seen
        assert found(spelling.variants(table)) == brute(seen, 5)


def test_long_chain_of_forms(spark):
    seen = {"a" * 5 + "b" * k: 5**k for k in range(1, 12)}
    assert found(spelling.variants(spark.createDataFrame(list(seen.items()), "word string, n long"))) == brute(seen, 5)


def test_empty_table(spark):
    assert spelling.variants(spelling.word_counts(documents(spark, []))).count() == 0
