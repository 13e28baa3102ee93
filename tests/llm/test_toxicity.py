import random

from data import documents, odd_rows, prose

from graphrank.llm import toxicity


def labelled(spark, n=240):
    draw = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        text, toxic = prose(i, 60), i % 4 == 0
        if toxic:
            words = text.split(" ")
            words.insert(draw.randrange(len(words)), draw.choice(["blargon", "zottel" + "".join(draw.sample("abcdef", 3))]))
            text = " ".join(words)
        rows.append((i, text, "aa", "s"))
        marks.append((i, int(toxic)))
    return rows, marks, documents(spark, rows), spark.createDataFrame([*marks, (5, None), (9999, 1)], "doc_id long, toxic int")


def test_learned_stems_find_unseen_words(spark):
    rows, marks, docs, labels = labelled(spark)
    model = toxicity.fit(docs.where("doc_id < 160"), labels)
    assert "blargon$" in model.stems and any(s.startswith("zott") and s in "zottel" for s in model.stems)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id >= 160"), model, ["doc_id"]).collect()}
    for (i, *_), (_, toxic) in zip(rows[160:], marks[160:], strict=True):
        assert (got[i] >= toxicity.THRESHOLD) == bool(toxic)


def test_odd_rows_and_no_labels(spark):
    docs = documents(spark, odd_rows())
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.stems == {}
    rows = toxicity.score(docs, model, ["doc_id", "text"]).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] < 0.3 for r in rows)
    assert toxicity.score(documents(spark, []), model, ["doc_id"]).count() == 0
    angry = toxicity.score(documents(spark, [(1, "you I will kill. fine", "aa", "s"), (2, "fine", "aa", "s")]), model, ["doc_id"]).collect()
    assert angry[0]["score"] > angry[1]["score"]


def test_grammar_marks_clauses():
    after, out, patterns = toxicity.grammar()

    def read(*symbols):
        state, found = 0, []
        for s in symbols:
            p, state = out[state][s], after[state][s]
            if p >= 0:
                found.append(patterns[p])
        return found

    t = toxicity
    assert read(t.OTHER, t.INSULT) == [(t.INSULT, frozenset())]
    assert read(t.NEGATION, t.OTHER, t.INSULT, t.INSULT) == [(t.INSULT, frozenset({"negated"})), (t.INSULT, frozenset())]
    assert read(t.NEGATION, t.OTHER, t.OTHER, t.OTHER, t.INSULT) == [(t.INSULT, frozenset())]
    assert read(t.REPORT, t.TARGET, t.THREAT) == [(t.THREAT, frozenset({"reported", "addressed"}))]
    assert read(t.REPORT, t.TARGET, t.END, t.THREAT) == [(t.THREAT, frozenset())]
