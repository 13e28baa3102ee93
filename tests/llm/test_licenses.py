import textwrap

from data import documents, odd_rows, prose

from graphrank.llm import licenses
from graphrank.llm.license_templates import TEMPLATES


def test_every_template_is_found(spark):
    rows = [(i, f"Some words before.\n{wording} And after it.\nmore", "aa", "s") for i, (_, wording) in enumerate(TEMPLATES)]
    got = {r["doc_id"]: r for r in licenses.licences(documents(spark, rows)).where("license IS NOT NULL").collect()}
    for i, (name, _) in enumerate(TEMPLATES):
        assert (got[i]["license"], got[i]["exact"], got[i]["first_line"]) == (name, True, 1)


def test_differences_decide():
    assert [r[2] for r in licenses.scan("Licensed under the Apache License, Version 1.1.")] == [None]
    assert [r[2] for r in licenses.scan("Licensed under CC BY-NC 3.0.")] == [None]
    long = TEMPLATES[4][1].replace("free of charge", "without any charge", 1)
    row, = licenses.scan(long.replace(". ", ".\n"))
    assert row[2] == "MIT" and row[5] and not row[7]
    both = licenses.scan("Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.")
    assert sorted(r[2] for r in both) == ["CC-BY-NC-4.0", "MIT", "MIT"]
    assert [r[2] for r in licenses.scan("All rights reserved by the lords of the manor.")] == [None]


def test_odd_rows(spark):
    assert licenses.licences(documents(spark, odd_rows())).count() == 0
    assert licenses.licences(documents(spark, [])).count() == 0
    rows = licenses.licences(documents(spark, [(None, "Released under the MIT License.", None, None)] * 2)).collect()
    assert [(r["doc_id"], r["license"]) for r in rows] == [(None, "MIT")] * 2


def test_more_notices_than_few():
    short = [(n, w) for n, w in TEMPLATES if len(w.split()) < 16]
    assert len(short) > 8
    got = licenses.scan("\n".join(w for _, w in short))
    assert sorted(r[2] for r in got) == sorted(n for n, _ in short) and all(r[7] for r in got)
    assert len({r[:2] for r in got}) == 1


def test_short_notice_in_a_very_long_line():
    far = " ".join(prose(k, 60).replace("\n", " ") for k in range(400))
    got = licenses.scan(f"{far} Software distributed under the License is distributed on an AS IS BASIS. {far} Licensed under CC BY-NC 4.0. {far}")
    assert [(r[2], r[7]) for r in got] == [("CC-BY-NC-4.0", True)]
    twice = "Licensed under CC BY 3.0.\nLicensed under CC BY 4.0."
    assert [r[2] for r in licenses.scan(twice)] == ["CC-BY-4.0"]


def test_wrapped_templates():
    for name, wording in TEMPLATES:
        for width in (72, 76, 78, 80):
            for mark in ("", " * ", "# "):
                text = "\n".join(f"{mark}{line}" for line in textwrap.wrap(wording, width))
                text = f"{prose(1, 300)}\n\n{text}\n\n{prose(2, 300)}"
                assert [(r[2], r[7]) for r in licenses.scan(text)] == [(name, True)], (name, width)


def test_list_numbers_tell_nothing():
    wording = TEMPLATES[6][1]
    for k, clause in enumerate(("Redistributions of source", "Redistributions in binary", "Neither the name"), 1):
        wording = wording.replace(clause, f"{k}. {clause}")
    for text in (wording, wording.replace("1. ", "\n\n1. ").replace("2. ", "\n2. ").replace("3. ", "\n3. "), "\n".join(textwrap.wrap(wording, 76)), wording.replace("1.", "(1)").replace("2.", "(2)").replace("3.", "(3)")):
        row, = licenses.scan(text)
        assert (row[2], row[5], row[6], row[7]) == ("BSD-3-Clause", 0, 3, False)
    for old in ("version\n3.", "version 3.", "version 1."):
        got = [r[2] for r in licenses.scan(f"This work is licensed under the GNU General Public License, {old} 4. More")]
        assert got == [None if "1" in old else "GPL-3.0"]
