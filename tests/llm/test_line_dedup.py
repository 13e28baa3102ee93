import zlib
from collections import defaultdict

import numpy as np
import pytest
from data import documents, odd_rows

from graphrank.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, keep_first):
    where = defaultdict(list)
    for i, t, *_ in rows:
        for pos, line in enumerate((t or "").split("\n")):
            key = line.strip(SPACE).translate(LOWER)
            if key:
                where[key].append(((i is None, i or 0), t or "", pos))
    dropped = set()
    for places in where.values():
        if len({d for d, *_ in places}) >= min_docs:
            dropped |= set(places)
            if keep_first:
                first = min(d for d, *_ in places)
                dropped -= {min((p for p in places if p[0] == first), key=lambda p: p[2])}
    return dropped


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("parts", ["1", "7"])
def test_against_brute_force(spark, keep_first, parts):
    common = [(100 + i, f"Common line\nown {i}\n  COMMON line \nlast {i % 4}", "aa", "s") for i in range(60)]
    # of one id with two texts the order of texts is that of a hash: left out where the first stays
    rows = [r for r in odd_rows() if r[0] is not None] + common
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    docs = documents(spark, rows)
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 3, keep_first)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    gone = brute(rows, 3, keep_first)
    assert len(cut) == len(rows)
    for r in cut:
        i, t = r["row"]["doc_id"], r["row"]["text"] or ""
        lines = t.split("\n")
        stay = [line for pos, line in enumerate(lines) if ((False, i), t, pos) not in gone]
        assert (r["n_lines"], r["n_dropped"], r["kept"]) == (len(lines), len(lines) - len(stay), "\n".join(stay))


def test_bitmaps_and_empty_table(spark):
    docs = documents(spark, [(i, "x\n" * 9 + f"{i}", "aa", "s") for i in range(5)])
    rows = line_dedup.keep_bitmaps(docs, 5, False).collect()
    assert len(rows) == 5
    bits = np.unpackbits(np.frombuffer(zlib.decompress(rows[0]["keep"]), dtype=np.uint8))
    assert list(bits[:9]) == [0] * 9 and bits[9:].all()
    none = documents(spark, [])
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
