"""The stages against brute-force versions, on whole small tables."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from data import documents, prose
from test_jaccard import brute as components_of
from test_line_dedup import LOWER, SPACE
from tokenizers import Tokenizer

from graphrank.llm import language
from graphrank.llm.queries import MIX, tokenizer_definition
from graphrank.llm.mixing import mix

WORD = re.compile("[^\x20\x09-\x0d]+")


def stage_rows(spark, tmp_path, docs):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_stages(spark, tmp_path):
    rows = [(i, prose(i, 50 + i, "aa" if i % 2 else "bb") + ("\nShared line of many" if i % 3 == 0 else ""), "aa" if i % 2 else "bb", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2], "s1") for i in range(5)] + [(200, None, "aa", "s0"), (201, "12 34", "bb", "s0"), (202, "Shared line of many", "aa", "s2")]
    docs = documents(spark, rows)
    first, second, third, fourth, fifth = stage_rows(spark, tmp_path, docs)
    for part in (first, second, third, fourth):
        assert list(part[0]) == docs.columns
    model = language.fit(docs)
    known = {r["doc_id"] for r in language.predict(docs, model, ["doc_id"]).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert {r["doc_id"] for r in first} == known and {200, 201}.isdisjoint(known) and len(first) == len(known)
    # lines
    where = defaultdict(set)
    for r in first:
        for pos, line in enumerate(r["text"].split("\n")):
            where[line.strip(SPACE).translate(LOWER)].add((r["doc_id"], pos))
    gone = set()
    for key, places in where.items():
        if key and len({i for i, _ in places}) >= 10:
            gone |= places - {min(places)}
    want = {}
    for r in first:
        lines = r["text"].split("\n")
        kept = "\n".join(line for pos, line in enumerate(lines) if (r["doc_id"], pos) not in gone)
        if kept == r["text"] or WORD.search(kept):
            want[r["doc_id"]] = kept
    assert {r["doc_id"]: r["text"] for r in second} == want and len(second) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in second)
    # near duplicates
    groups = components_of([(r["doc_id"], r["text"]) for r in second], 5, 80)
    assert sorted(r["doc_id"] for r in third) == sorted(i for i, (_, name) in groups.items() if i == name)
    # mix: as often as words are taken
    taken = {r["row"]["doc_id"]: -(-r["taken"] // r["size"]) for r in mix(spark.read.parquet(f"{tmp_path}/2"), keep=["doc_id"], **MIX).collect()}
    seen = defaultdict(int)
    for r in fourth:
        seen[r["doc_id"]] += 1
    assert dict(seen) == {i: n for i, n in taken.items() if n}
    # pieces
    whole = Tokenizer.from_str(tokenizer_definition())
    expected = []
    for r in fourth:
        ids = np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [(r["doc_id"], k, zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in fifth) == sorted(expected)
