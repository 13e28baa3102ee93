"""Rows that every operator has to bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size long, row string, node string"

_SYLLABLES = {"aa": "the ing and ion er es".split(), "bb": "der ung und sch en ich".split()}


def prose(seed: int, n: int, lang: str = "aa") -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choice(_SYLLABLES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n)]
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(words))


def documents(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use themselves."""
    full = [(i, t, lang, s, len(t or ""), "x", 7, "r", "n") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    base = [(k, prose(k, 40 + k, "aa" if k % 2 else "bb"), "aa" if k % 2 else "bb", f"s{k % 3}") for k in range(1, 31)]
    return [
        *base,
        (31, None, "aa", "s0"), (32, "", "aa", None), (33, " \t\n \n", None, "s1"), (None, prose(5, 60), "aa", "s1"), (None, None, None, None),
        (34, prose(34, 6000), "aa", "s0"), (35, "123 !!! 456", "bb", "s2"), (36, prose(36, 30), None, None),
        (37, base[3][1], "bb", "s0"), (38, base[3][1], "bb", "s0"), (4, base[3][1], "bb", "s1"),  # copies, and a repeated row
    ]
