import numpy as np
from data import documents, odd_rows, prose

from graphrank.llm import language


def test_held_out_accuracy_and_odd_rows(spark):
    train = documents(spark, [(i, prose(i, 50, lang), lang, "s") for i in range(60) for lang in ("aa", "bb")])
    model = language.fit(train)
    fresh = documents(spark, [(i, prose(1000 + i, 12, lang), lang, "s") for i in range(40) for lang in ("aa", "bb")])
    rows = language.predict(fresh, model, ["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = language.predict(documents(spark, odd_rows()), model, ["doc_id", "text"]).collect()
    assert len(odd) == len(odd_rows())
    for r in odd:
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    kept = language.accepted(documents(spark, odd_rows()), model)
    assert kept.columns == documents(spark, []).columns
    assert {31, 32, 33, 35}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_without_rows_or_labels(spark):
    empty = language.fit(documents(spark, []))
    assert empty.languages == []
    rows = language.predict(documents(spark, [(1, "abc", None, "s")]), empty, ["doc_id"]).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    assert language.predict(documents(spark, []), empty, ["doc_id"]).count() == 0


def test_ngrams_hold_no_break_inside():
    one, two, three = (len(i) for i, _ in language.features(["ab cd"]))
    assert (one, two, three) == (4, 6, 4)


def test_copies_and_no_labels(spark):
    rows = [(i, prose(7, 40, "aa"), "aa", "s") for i in range(400)] + [(1000 + i, prose(i, 40, "bb"), "bb", "s") for i in range(40)]
    for seed in range(3):  # a few distinct texts among many copies
        rows += [(2000 + seed * 100 + i, prose(50 + seed, 40, "aa"), "aa", "s") for i in range(50)]
    model = language.fit(documents(spark, rows), rows=8)
    spread = model.log_probability.max(axis=0) - model.log_probability.min(axis=0)
    assert (spread > 1).all()
    fresh = documents(spark, [(i, prose(3000 + i, 30, lang), lang, "s") for i in range(20) for lang in ("aa", "bb")])
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(fresh, model, ["lang"]).collect())
    none = documents(spark, [(1, "abc", None, "s"), (2, "12 3", None, "s"), (3, None, None, "s"), (4, "é", None, "s")])
    assert sorted(r["doc_id"] for r in language.accepted(none, language.fit(none)).collect()) == [1, 4]


def test_more_languages_than_fit_at_once(spark, monkeypatch):
    """Junk in the language column costs buckets, not the job; blocks of columns and texts give what one block gives."""
    rows = [(i, prose(i, 50, lang), lang, "s") for i in range(60) for lang in ("aa", "bb")] + [(5000 + i, f"q{i}x", f"junk{i}", "s") for i in range(600)]
    monkeypatch.setattr(language, "CELLS", 1 << 20)
    model = language.fit(documents(spark, rows))
    assert len(model.languages) == 602 and model.log_probability.shape[0] == (1 << 20) // 602
    texts = [prose(7000 + i, 30, lang) for i in range(40) for lang in ("aa", "bb")]
    number, score = model.score(texts)
    assert sum(model.languages[n] == lang for n, lang in zip(number, ["aa", "bb"] * 40)) >= 78
    monkeypatch.setattr(language, "_COLUMNS", 1000)
    monkeypatch.setattr(language, "_SCORES", 1 << 30)
    again = model.score(texts)
    assert (again[0] == number).all() and np.allclose(again[1], score)


def test_model_against_plain_counts(spark):
    """The same model counted and scored one n-gram at a time."""
    rows = [(i, prose(i, 12, lang), lang, "s") for i in range(6) for lang in ("aa", "bb")]
    model = language.fit(documents(spark, rows), rows=10**6, buckets=256)
    counts = {lang: np.full(256, 0.1) for lang in ("aa", "bb")}
    for text, lang in {(t, lang) for _, t, lang, _ in rows}:
        for index, _ in language.features([text], 256):
            for k in index:
                counts[lang][k] += 1
    for text in [prose(90 + i, 5 + i, "bb") for i in range(5)] + ["x", "ab cd"]:
        logs = []
        for lang in ("aa", "bb"):
            p = np.log(counts[lang] / counts[lang].sum())
            logs.append(sum(p[k] for index, _ in language.features([text], 256) for k in index) / language.MAX_ORDER + np.log(0.5))
        share = np.exp(np.array(logs) - max(logs))
        share /= share.sum()
        number, score = model.score([text])
        assert number[0] == share.argmax() and abs(score[0] - share.max()) < 1e-3
