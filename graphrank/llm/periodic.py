"""Periodic runs of words: stretches that repeat their first words over and over.

Each batch of whole texts becomes one array of word numbers, with a mark between texts that equals no word. Then

* **short periods** are lag scans: where words ``q`` apart are equal in a row, for every ``q`` below ``SHORTEST``;
* **longer periods** are seeded at the scales w = 16, 32, 64, ...: the least word hash of every window of w words. A run of period q,
  w <= q < 2w, has the same window minima one period later, followed by the same 2w words. So for each text the positions
  are sorted by the fingerprint of their next 2w words, and neighbours in that order at a distance of w to 2w - 1 are seeds.
  Four periods hold at least one such pair, and as 2w > q no equal fingerprint lies between the two. A seed is
  extended word by word in both directions, so the runs themselves are exact.

A stretch of period q and a divisor of q is the same stretch for both; the smallest period stays.

Work and memory of a batch follow its words: a text takes part in the scales up to a fourth of its length.

Cases: a null, empty or blank text has no words and no runs; a very long text is one batch; rows with
a null doc_id keep their words as they are; repeated rows get equal results; columns other than
the two named are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.llm.common import lean, numbered_words, ship, text_parts

#: Periods below are scanned directly; also the window of the first scale.
SHORTEST = 16
#: Least words of a run, and least number of its periods.
LEAST_WORDS, LEAST_TIMES = 6, 4

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least(period: int) -> int:
    return max(LEAST_WORDS, LEAST_TIMES * period)


def _lag_runs(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal stretches of period ``lag`` that are long enough.

    A stretch as long as a run covers a full period of equal words, so it cannot hold a mark between texts.
    """
    differ = np.flatnonzero(x[:-lag] != x[lag:])
    bounds = np.concatenate([[-1], differ, [len(x) - lag]])
    equal = np.diff(bounds) - 1
    at = np.flatnonzero(equal >= _least(lag) - lag)
    return bounds[at] + 1, equal[at] + lag


def _extend(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """(start, length) of the stretch of period ``lag`` around ``at``. Marks end it on both sides."""
    step = max(64, lag)
    right = at
    while True:
        differ = np.flatnonzero(x[right : right + step][: len(x) - lag - right] != x[right + lag : right + lag + step])
        if len(differ):
            right += int(differ[0])
            break
        right += step
    left = at
    while True:
        low = max(0, left - step)
        differ = np.flatnonzero(x[low:left] != x[low + lag : left + lag])
        if len(differ):
            left = low + int(differ[-1]) + 1
            break
        left = low
    return left, right - left + lag


def _seeds(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(position, period) of candidates, scale by scale; ascending positions for each text and period."""
    window = SHORTEST
    long_enough = sizes >= LEAST_TIMES * window
    if not long_enough.any():
        return
    starts, sizes = starts[long_enough], sizes[long_enough]

    def places(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
        upto = np.cumsum(n) - n
        return np.repeat(begin - upto, n) + np.arange(int(n.sum()))

    origin = places(sizes, starts)  # place in x of every word that takes part
    rank = _mixed(x[origin].astype(np.uint64) * _ODD + np.uint64(1))
    print_ = rank  # of one word
    offset = np.zeros(len(rank), dtype=np.int32)  # of the least hash in the window that begins here
    width = 1

    def doubled(value: np.ndarray, w: int) -> np.ndarray:
        return _mixed(value[:-w] * _ODD + (value[w:] ^ np.uint64(w)))

    def least_of_two(off: np.ndarray, w: int) -> np.ndarray:
        here = np.arange(len(off) - w)
        a, b = off[:-w], off[w:] + w
        last = len(rank) - 1  # windows over the end of a text may point past all texts; they are never read
        return np.where(rank[np.minimum(here + a, last)] <= rank[np.minimum(here + b, last)], a, b).astype(np.int32)

    while width < window:
        offset, print_, width = least_of_two(offset, width), doubled(print_, width), 2 * width
    while True:
        ends = np.cumsum(sizes)
        begin = ends - sizes
        twice = doubled(print_, window)  # fingerprints of 2w words
        at = places(sizes - window + 1, begin)  # windows inside one text
        least = at + offset[at]
        text = np.repeat(np.arange(len(sizes)), sizes - window + 1)
        new = np.ones(len(least), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        new &= least + 2 * window <= ends[text]
        least, text = least[new], text[new]
        sign = twice[least] ^ _mixed(text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(sign, kind="stable")
        sign, place, of = sign[order], least[order], text[order]
        far = place[1:] - place[:-1]
        pair = np.flatnonzero((sign[1:] == sign[:-1]) & (of[1:] == of[:-1]) & (far >= window) & (far < 2 * window))
        found, period = origin[place[pair]], far[pair]
        for k in np.lexsort((found, period)):
            yield int(found[k]), int(period[k])
        window *= 2
        stay = sizes >= LEAST_TIMES * window
        if not stay.any():
            return
        offset, print_ = least_of_two(offset, window // 2), twice
        if not stay.all():
            part = np.repeat(stay, sizes)
            origin, rank = origin[part], rank[part]
            offset, print_ = offset[part[: len(offset)]], print_[part[: len(print_)]]
            sizes = sizes[stay]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text (start, length, period) of all its runs, by start, then period. ``words``: numbers of the words of all texts in a row."""
    upto = np.cumsum(sizes)
    starts = upto - sizes + np.arange(len(sizes)) + 1  # one mark before each text
    x = np.empty(len(words) + len(sizes) + 1, dtype=np.int64)
    marks = np.concatenate([starts - 1, [len(x) - 1]])
    x[marks] = -1 - np.arange(len(marks))
    inside = np.ones(len(x), dtype=bool)
    inside[marks] = False
    x[inside] = words

    shortest: dict[tuple[int, int], int] = {}  # (start, length) -> period

    def add(start: int, length: int, period: int) -> None:
        known = shortest.get((start, length))
        if known is None or period < known:
            shortest[start, length] = period

    longest = int(sizes.max(initial=0))
    for lag in range(1, SHORTEST):
        if longest < _least(lag):
            break
        for start, length in zip(*(a.tolist() for a in _lag_runs(x, lag)), strict=True):
            add(start, length, lag)
    done = (0, 0)  # period and end of the stretch last extended
    for at, period in _seeds(x, starts, np.asarray(sizes)):
        if period == done[0] and at + period < done[1]:
            continue
        start, length = _extend(x, at, period)
        done = (period, start + length)
        if length >= _least(period):
            add(start, length, period)

    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for (start, length), period in shortest.items():
        text = int(np.searchsorted(starts, start, side="right")) - 1
        out[text].append((start - int(starts[text]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def most_periodic(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties go to the smaller start, then period."""
    best = None
    for run in runs:  # they come by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def plant(words: np.ndarray, doc_id: int) -> np.ndarray:
    """The contract's change: in one of ten documents the words from some place on repeat with some period."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    changed = words.copy()
    changed[a:] = words[a + np.arange(n - a) % period]
    return changed


_RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
           "runs array<struct<start: long, length: long, period: long>>")


def periodic_runs(documents: DataFrame, planted: bool = False, collapsed: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, all runs, the most periodic one, and digests of the runs and of the text without its repetitions.

    ``collapsed`` adds that text itself, its words joined by one space. ``planted`` makes the contract's change first.
    """
    ship(documents.sparkSession)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_parts(whole, 1):
                distinct, words, sizes = numbered_words(batch.column(1))
                ends = np.cumsum(sizes)
                if planted:
                    for k, key in enumerate(batch.column(0).to_pylist()):
                        if key is not None:
                            words[ends[k] - sizes[k] : ends[k]] = plant(words[ends[k] - sizes[k] : ends[k]], key)
                found = find_runs(words, sizes)
                drop = np.zeros(len(words) + 1, dtype=np.int64)
                for begin, runs in zip((ends - sizes).tolist(), found, strict=True):
                    for start, length, period in runs:
                        drop[begin + start + period] += 1
                        drop[begin + start + length] -= 1
                keep = np.cumsum(drop[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
                lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), distinct.take(pa.array(words[keep])))
                short = pc.binary_join(lists, " ")
                best = [most_periodic(runs) for runs in found]
                said = ["".join(f"{s},{n},{q}\n" for s, n, q in runs) for runs in found]
                columns = [
                    batch.column(0), pa.array([len(r) for r in found], pa.int64()),
                    *[pa.array([b and b[i] for b in best], pa.int64()) for i in range(3)],
                    pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for s in said]),
                    pa.array([hashlib.sha256(s.as_py().encode()).hexdigest() for s in short], pa.string()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found],
                             pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                ]
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
                yield pa.RecordBatch.from_arrays(columns + [short] * collapsed, names=names + ["collapsed"] * collapsed)

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        scan, f"doc_id {kind}, {_RESULT}" + (", collapsed string" if collapsed else ""))
