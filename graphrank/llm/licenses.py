"""Licence scan by conditional compression.

Lines that may belong to a licence are joined to blocks. A block is compressed alone and with each template as a
raw zstandard dictionary; the more of the block the template already says, the more bytes it saves. That ranks the
templates. All that share three words in a row with the block or its surroundings are compared with it word by word, in this
order: the differences from the template's first to its last word that is there are exact, and decide. A licence is
confirmed if at most a tenth of its words are missing, changed or added, and no word that tells it from another licence.

Cases: null and empty texts have no block; lines are split at line feeds; hint lines at most ``GAP`` lines apart are one
block with what stands between, and so are all lines of a confirmed licence; equal reductions go to the first template, and
a template that holds another one goes before it; list numbers tell nothing; a block with several licences gives a row for
each; repeated rows give equal rows; a block without a confirmed licence is one row with a null licence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.llm.common import ship
from graphrank.llm.license_templates import HINT, TEMPLATES

#: Lines between hint lines of one block, most differing words' share, words in a row that make a template worth comparing.
GAP, MOST_CHANGED, SEED = 4, 0.1, 3
_WORDS = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")
#: Numbers of list items, at the start of a line or after a sentence; a number after these words is a version.
_ITEM = re.compile(r"(?P<start>^\W*)(\d{1,2})[.)](?=\s|$)|[.:;,]\s+(?:and\s+|or\s+)?\(?(\d{1,2})[.)](?=\s|$)")
_VERSIONED, _NAMED = frozenset("v ver version versions".split()), frozenset("v ver version versions license licence gpl lgpl agpl apache mpl bsd cc by sa nc nd".split())
#: Words that tell one licence from another: none of them may differ. List numbers are written with a number sign.
_TELLING = re.compile(r"^[^#]*\d|^(?:nc|sa|nd|by|by-.*|cc0?|mit|bsd|apache|gnu|lesser|affero|general|mozilla|attribution.*|noncommercial|sharealike)$")
_SCHEMA = ("first_line int, n_lines int, license string, template int, saved double, missing int, added int, exact boolean")
_state: dict = {}


def normal_words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def line_words(line: str, before: str | None) -> list[str]:
    """Words of a line, with ``#`` before the numbers of list items; ``before`` is the last word of the line before."""
    line = line.lower()
    items = set()
    for m in _ITEM.finditer(line):
        if m["start"] is not None:
            version = before in _NAMED
        else:
            said = _WORDS.findall(line, max(0, m.start() - 40), m.start())
            version = bool(said) and said[-1] in (_NAMED if line[m.start()] == "," else _VERSIONED)
        if not version:
            items.add(m.start(2) if m["start"] is not None else m.start(3))
    if not items:
        return _WORDS.findall(line)
    return [f"#{m[0]}" if m.start() in items else m[0] for m in _WORDS.finditer(line)]


def _templates():
    """Per template: name, words, compressor with the template as dictionary. Made once in a worker."""
    if "templates" not in _state:
        import zstandard as zstd

        plain = []
        for name, wording in TEMPLATES:
            words = normal_words(wording)
            known = zstd.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            plain.append((name, words, zstd.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _state["alone"] = zstd.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        seeds: dict[tuple, list[tuple[int, int]]] = {}
        for n, (_, words, _) in enumerate(plain):
            first: dict[tuple, int] = {}
            for i in range(len(words) - SEED + 1):
                first.setdefault(tuple(words[i : i + SEED]), i)
            for gram, i in first.items():
                seeds.setdefault(gram, []).append((n, i))
        said = [f" {' '.join(words)} " for _, words, _ in plain]
        _state["seeds"] = seeds
        _state["holders"] = [[m for m, whole in enumerate(said) if len(whole) > len(part) and part in whole] for part in said]
        _state["templates"] = plain
    return _state["alone"], _state["templates"]


def blocks(lines: list[str]) -> list[list[int]]:
    """[first line, last line] of every block of hint lines."""
    hint = _state.setdefault("hint", re.compile(HINT))
    out: list[list[int]] = []
    for i, line in enumerate(lines):
        if hint.search(line):
            if out and i - out[-1][1] <= GAP:
                out[-1][1] = i
            else:
                out.append([i, i])
    return out


def differences(template: list[str], words: list[str], taken: list[bool], start: int) -> tuple[int, int, bool, int, int] | None:
    """(missing, added, whether a telling word differs, begin, end) of the template about word ``start``, clipped where they are fewest."""
    slack = len(template) // 4
    low, high = max(0, start - slack), min(len(words), start + len(template) + slack + 1)
    part = [None if taken[k] else words[k] for k in range(low, high)]
    codes = SequenceMatcher(None, template, part, autojunk=False).get_opcodes()
    same = [k for k, c in enumerate(codes) if c[0] == "equal"]
    if not same:
        return None
    apart, sums = 0, {}  # differing words before each equal stretch
    for k in range(same[0], same[-1] + 1):
        what, a, b, c, d = codes[k]
        if what == "equal":
            sums[k] = apart
        else:
            apart += b - a + d - c
    left = min(same, key=lambda k: codes[k][1] - sums[k])
    right = min((k for k in same if k >= left), key=lambda k: sums[k] - codes[k][2])
    between = [c for c in codes[left:right] if c[0] != "equal"]
    lost = [*template[: codes[left][1]], *(w for _, a, b, _, _ in between for w in template[a:b]), *template[codes[right][2] :]]
    extra = [w for _, _, _, c, d in between for w in part[c:d]]
    telling = any(w is not None and _TELLING.search(w) for w in (*lost, *extra))
    return len(lost), len(extra), telling, low + codes[left][3], low + codes[right][4]


def confirmed(template: list[str], words: list[str], taken: list[bool], starts: set[int], inside: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(missing, added, begin, end) of every place of the template that touches the words ``inside``; marks the words as taken."""
    while True:
        near = set()
        for start in starts:
            found = differences(template, words, taken, start)
            if found:
                missing, added, telling, begin, end = found
                if not telling and missing + added <= MOST_CHANGED * len(template) and begin < inside[1] and end > inside[0]:
                    near.add((missing + added, missing, added, begin, end))
        some = False
        for _, missing, added, begin, end in sorted(near):
            if not any(taken[begin:end]):
                taken[begin:end] = [True] * (end - begin)
                some = True
                yield missing, added, begin, end
        if not some:
            return


def scan(text: str | None) -> list[tuple]:
    """Rows of all blocks of a text, in the columns of ``_SCHEMA``."""
    if not text:
        return []
    alone, templates = _templates()
    lines = text.split("\n")
    words: list[str] = []
    place, at = [0], []  # place of each line's first word, line of each word
    for i, line in enumerate(lines):
        said = line_words(line, words[-1] if i and place[-1] > place[-2] else None)
        words += said
        at += [i] * len(said)
        place.append(len(words))
    taken = [False] * len(words)
    seeds = [(j, n, j - i) for j in range(len(words) - SEED + 1) for n, i in _state["seeds"].get(tuple(words[j : j + SEED]), ())]
    reach = max(len(t) for _, t, _ in templates) * 5 // 4 + 1
    out: list[list] = []  # first line, last line, best saving, rows
    for a, b in blocks(lines):
        inside = place[a], place[b + 1]
        data = " ".join(words[slice(*inside)]).replace("#", "").encode()
        size = len(alone.compress(data))
        saved = [len(c.compress(data)) - size for _, _, c in templates]
        ranked = sorted(range(len(templates)), key=lambda n: (saved[n], n))
        starts: dict[int, set[int]] = {}
        for _, n, start in seeds[bisect_left(seeds, (inside[0] - reach,)) : bisect_left(seeds, (inside[1] + reach,))]:
            starts.setdefault(n, set()).add(start)
        rows, first, last = [], a, b
        for n in dict.fromkeys(m for n in ranked for m in (*_state["holders"][n], n)):
            name, template, _ = templates[n]
            for missing, added, begin, end in confirmed(template, words, taken, starts.get(n, set()), inside):
                rows.append((name, n, -saved[n] / size, missing, added, missing == added == 0))
                first, last = min(first, at[begin]), max(last, at[end - 1])
        best = max(0.0, -saved[ranked[0]] / size)
        while out and out[-1][1] >= first:
            before = out.pop()
            first, last, best, rows = min(first, before[0]), max(last, before[1]), max(best, before[2]), before[3] + rows
        out.append([first, last, best, rows])
    return [(first, last - first + 1, *row) for first, last, best, rows in out for row in rows or [(None, None, best, None, None, False)]]


def licences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first_line, n_lines, license, template, saved, missing, added, exact."""
    ship(documents.sparkSession)
    fields = [f.rsplit(" ", 1) for f in _SCHEMA.split(", ")]
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *row) for i, value in enumerate(batch.column(1)) for row in scan(value.as_py())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k + 1] for r in rows], types[t]) for k, (_, t) in enumerate(fields))],
                names=["doc_id", *(f for f, _ in fields)])

    kind = documents.schema[doc_id].dataType.simpleString()
    some = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(HINT))
    return some.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
