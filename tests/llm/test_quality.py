import random
import re

import numpy as np
from data import documents, odd_rows, prose
from pyspark.sql import functions as F

from graphrank.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    rows = [*odd_rows(), (60, "a b c d e f g h " * 9 + prose(1, 90), "aa", "s"), (61, "x y\n\nx y\n x y\nx y", "aa", "s"), (62, "é# |$ <&>* %", "aa", "s")]
    got = quality.verdicts(documents(spark, rows), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        found = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert found == base(r["row"]["text"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.verdicts(documents(spark, []), ["doc_id"]).count() == 0


def test_outliers_of_a_group_go(spark):
    rows = [(i, prose(i, 80 + i % 50), "aa", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{w}***" for w in prose(i, 90).split()), "aa", "s") for i in range(60)]
    rows += [(2000 + i, prose(i, 90), None, "rare") for i in range(5)]
    got = quality.verdicts(documents(spark, rows), ["doc_id"]).collect()
    kept = {r["row"]["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in kept if i < 1000 or i >= 2000)
    assert not any(kept[1000 + i] for i in range(60))


def test_inverse(spark):
    a = np.array([[2.0, 0.3, 0.1], [0.3, 1.5, -0.2], [0.1, -0.2, 0.7]])
    got = spark.range(1).select(quality._inverse(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in a]), 3).alias("x")).first()["x"]
    assert np.allclose(got, np.linalg.inv(a))


def test_repetition_alone_rejects(spark):
    rows = [(i, prose(i, 80 + i % 50), "aa", "s") for i in range(300)]
    draw = random.Random(1)
    short = [prose(900 + k, 3).strip() for k in range(12)]
    lines = "\n".join(draw.choice(short) for _ in range(60))  # changing order: no run of eight words comes twice
    rows.append((1000, lines, "aa", "s"))
    said = prose(5000, 15).replace("\n", " ")
    rows.append((1001, said + prose(5001, 70).replace("\n", " ") + said, "aa", "s"))
    got = {r["row"]["doc_id"]: r for r in quality.verdicts(documents(spark, rows), ["doc_id"]).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert [(got[i]["base_failed"], got[i]["kept"]) for i in (1000, 1001)] == [(False, False)] * 2


def test_small_groups_are_judged_by_wider_ones(spark):
    rows = [(i, prose(i, 80 + i % 50), "aa", "s") for i in range(120)]
    for i, (lang, source) in enumerate((("aa", "rare"), ("bb", "rare"), (None, None))):
        rows.append((1000 + i, " ".join(f"{w}***" for w in prose(i, 90).split()), lang, source))
        rows.append((2000 + i, prose(500 + i, 90), lang, source))
    got = {r["row"]["doc_id"]: r["kept"] for r in quality.verdicts(documents(spark, rows), ["doc_id"]).collect()}
    assert got == {i: not 1000 <= i < 2000 for i in got} and len(got) == len(rows)


def vector(text):
    n, chars, symbols, lines, repeats, _ = base(text)
    filled = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    return [np.log1p(n), np.log(max(chars, 1) / max(n, 1)), np.log1p(100 * symbols / max(n, 1)), np.log1p(10 * lines / max(filled, 1)), np.log1p(100 * repeats / max(n, 1))]


def estimate(x):
    """(mean, precision, scale) by concentration steps in numpy."""
    floor = np.array(list(quality.FLOORS.values())) ** 2

    def share(values, p):
        return np.sort(values, axis=0)[max(0, int(np.ceil(p * len(values))) - 1)]

    def distances(mean, precision):
        return np.einsum("ni,ij,nj->n", x - mean, precision, x - mean)

    mean = share(x, 0.5)
    precision = np.diag(1 / np.maximum(((share(x, 0.75) - share(x, 0.25)) / 1.349) ** 2, floor))
    for _ in range(quality.STEPS):
        far = distances(mean, precision)
        near = x[far <= share(far, quality.SHARE)]
        mean = near.mean(axis=0)
        covariance = near.T @ near / len(near) - np.outer(mean, mean)
        np.fill_diagonal(covariance, np.maximum(np.diag(covariance), floor) + quality.RIDGE)
        precision = np.linalg.inv(covariance)
    return mean, precision, max(1.0, share(distances(mean, precision), 0.5) / quality.HALF)


def test_verdicts_against_numpy(spark):
    """Two groups, of which one is hot, with junk of several kinds in each."""
    draw = random.Random(8)
    rows = []
    for i in range(520):
        text = prose(i, draw.randint(25, 200), "aa" if i % 4 else "bb")
        if i % 9 == 0:
            text = re.sub(" ", draw.choice(["# ", " & ", "  "]), text)
        if i % 13 == 0:
            text += "\n" + "\n".join(text.split("\n")[:3])
        if i % 17 == 0:
            text = re.sub("[aeiou]", "", text) or text
        rows.append((i, text, "aa" if i % 4 else "bb", "hot"))
    got = {r["row"]["doc_id"]: r for r in quality.verdicts(documents(spark, rows), ["doc_id"]).collect()}
    seen = set()
    for lang in ("aa", "bb"):
        sound = [(i, vector(t)) for i, t, of, _ in rows if of == lang and not base(t)[-1]]
        mean, precision, scale = estimate(np.array([v for _, v in sound]))
        for i, v in sound:
            distance = (v - mean) @ precision @ (v - mean) / scale
            assert abs(got[i]["distance"] - distance) < 1e-6 * max(1, distance)
            assert got[i]["kept"] == (distance <= quality.CUTOFF)
            seen.add(got[i]["kept"])
    assert seen == {True, False}
