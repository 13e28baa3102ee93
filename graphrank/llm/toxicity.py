"""Toxicity by a weighted finite-state grammar over clauses.

A word becomes a symbol: insult, threat, target, negation, reported speech, other. Symbols run through three
transducers, composed into one table: negation marks insults and threats in the three words behind it, reported
speech those up to the end of its clause, target those in a clause that addresses someone. What comes out of a clause
is a list of patterns (insult, negated insult, reported threat at a target, ...). An insult carries the weight of
its word, a pattern has a weight of its own; a document's score is the logistic function of what adds up.

Insults are learned: stems whose share among toxic texts is above that among clean ones, weighted with the logarithm
of the ratio. A longer stem stands beside a shorter one if it tells more, and the longest that fits counts. Pattern weights are fitted to the same texts. Clauses without an insult or threat
match nothing, whatever other words they hold.

Cases: null and empty texts match nothing and have the lowest score; a label that is null, or of no document,
teaches nothing, of several labels of a document the largest counts; repeated rows are scored alike; without toxic or
without clean labels the fixed lists alone decide.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.llm.common import materialize, ship

#: Labelled texts that the lexicon and the weights are fitted to, about, drawn by a hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 8192, 16384
#: A stem has so many letters and toxic texts at least, and at least this log ratio of shares and this test statistic.
STEM, TEXTS, LOG_RATIO, STATISTIC = 4, 8, 1.2, 30.0
#: What a longer stem must tell more, in so many toxic texts at least, and the most that one word counts.
MORE, FAMILY_TEXTS, MOST = 0.5, 3, 6.0
THREAT_WEIGHT = 3.0
LONGEST_STEM = 12
THRESHOLD = 0.3

THREATS = "kill murder shoot hang stab beat hurt destroy burn strangle töten umbringen erschießen tuer frapper matar golpear disparar".split()
TARGETS = "you your yours yourself he him his she her they them their people du dich dein euch sie tu toi vous ton eux ellos ustedes usted".split()
NEGATIONS = "not never no nobody neither without cannot nicht nie kein keine ne pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say wrote writes called calls quoted quotes claimed alleged sagte schrieb behauptete dit écrit déclaré dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
_CLAUSE = re.compile(r"[.!?;:\n\r]+")
_LETTERS = re.compile(r"[^\W\d_]+")


# ---- transducers ----


@dataclass(frozen=True)
class Transducer:
    """``step(state, symbol)`` gives (state, symbol). A symbol is (class, marks)."""

    step: object
    start: object = 0

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is read by the other."""
        first, second = self.step, other.step

        def both(state, symbol):
            a, out = first(state[0], symbol)
            b, out = second(state[1], out)
            return (a, b), out

        return Transducer(both, (self.start, other.start))

    def table(self, symbols: list) -> tuple[np.ndarray, np.ndarray, list]:
        """(next state, output) per state and input symbol, and the outputs, for all states that can be reached."""
        number, todo, outputs = {self.start: 0}, deque([self.start]), {}
        rows = []
        while todo:
            state = todo.popleft()
            row = []
            for symbol in symbols:
                after, out = self.step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append((number[after], outputs.setdefault(out, len(outputs))))
            rows.append(row)
        table = np.array(rows)
        return table[:, :, 0], table[:, :, 1], list(outputs)


def _negation(left, symbol):
    kind, marks = symbol
    if kind == NEGATION:
        return 3, symbol
    if kind == END:
        return 0, symbol
    if kind in (INSULT, THREAT) and left:
        return 0, (kind, marks | {"negated"})
    return max(0, left - 1), symbol


def _reported(inside, symbol):
    kind, marks = symbol
    if kind in (REPORT, END):
        return int(kind == REPORT), symbol
    return inside, ((kind, marks | {"reported"}) if kind in (INSULT, THREAT) and inside else symbol)


def _addressed(inside, symbol):
    kind, marks = symbol
    if kind in (TARGET, END):
        return int(kind == TARGET), symbol
    return inside, ((kind, marks | {"addressed"}) if kind in (INSULT, THREAT) and inside else symbol)


def grammar() -> tuple[list, list, list[tuple]]:
    """Next states, outputs (number of a pattern or -1) and patterns of the composed transducer."""
    composed = Transducer(_negation).then(Transducer(_reported)).then(Transducer(_addressed))
    after, out, symbols = composed.table([(kind, frozenset()) for kind in range(7)])
    patterns = sorted((s for s in symbols if s[0] in (INSULT, THREAT)), key=lambda s: (s[0], sorted(s[1])))
    number = {s: i for i, s in enumerate(patterns)}
    return after.tolist(), [[number.get(symbols[o], -1) for o in row] for row in out.tolist()], patterns


# ---- words ----


class Lexicon:
    """Weights of insult stems; a stem that ends with ``$`` is a whole word."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        self.fixed = {w: k for k, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}

    def symbol(self, word: str) -> tuple[int, float]:
        """Class and weight of a word: the longest stem that fits makes it an insult."""
        whole = word + "$"
        for n in self.sizes:
            weight = self.stems.get(whole[:n]) if n <= len(whole) else None
            if weight is not None:
                return INSULT, weight
        return self.fixed.get(word, OTHER), THREAT_WEIGHT

    def hits(self, text: str) -> bool:
        """Whether a run of characters without white space holds an insult or threat."""
        return any(self.symbol(w)[0] in (INSULT, THREAT) for w in ((text,) if text.isalpha() else _LETTERS.findall(text)))


def prefixes(text: str) -> set[str]:
    """Beginnings of the words of a text, the whole word with its end mark among them."""
    out = set()
    for word in set(_LETTERS.findall(text.lower())):
        whole = word + "$"
        out.update(whole[:n] for n in range(STEM, min(len(whole), LONGEST_STEM) + 1))
    return out


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of stems from (toxic texts, clean texts) per beginning."""
    def weight(n1: int, n0: int) -> float:
        return min(MOST, float(np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1))))

    def strong(n1: int, n0: int) -> bool:
        if n1 < TEXTS or weight(n1, n0) < LOG_RATIO:
            return False
        both = (n1 + n0) / (toxic + clean)
        return 2 * (n1 * np.log(n1 / (toxic * both)) + (n0 * np.log(n0 / (clean * both)) if n0 else 0)) >= STATISTIC

    longer: dict[str, list[str]] = {}
    for p in counts:
        longer.setdefault(p[:-1], []).append(p)
    chosen: dict[str, float] = {}
    for p in sorted(counts, key=lambda p: (len(p), p)):
        above = max((chosen[p[:n]] for n in range(STEM, len(p)) if p[:n] in chosen), default=0.0)
        if above and counts[p][0] >= FAMILY_TEXTS and weight(*counts[p]) >= above + MORE or not above and strong(*counts[p]):
            chosen[p] = weight(*counts[p])
    out = {}
    for p, known in chosen.items():  # a longer stem that loses next to no toxic text is safer
        while True:
            after = max(longer.get(p, []), key=lambda q: counts[q][0], default=None)
            if after is None or counts[after][0] < 0.97 * counts[p][0]:
                break
            p, known = after, max(known, weight(*counts[after]))
        out[p] = max(known, out.get(p, 0.0))
    return out


# ---- texts ----

_TOGETHER = 1 << 22


def pattern_sums(texts: pa.Array, lexicon: Lexicon, machine: tuple) -> np.ndarray:
    """Sums of word weights (texts, patterns). Only texts with an insult or threat are read clause by clause."""
    after, out, patterns = machine
    sums = np.zeros((len(texts), len(patterns)))
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    hit = np.array([lexicon.hits(w) for w in coded.dictionary.to_pylist()], dtype=bool)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    upto = np.concatenate([[0], np.cumsum(hit[coded.indices.to_numpy()])]) if len(coded) else np.zeros(1, dtype=np.int64)
    for i in np.flatnonzero(np.diff(upto[bounds])):
        for clause in _CLAUSE.split(lower[int(i)].as_py()):
            state = 0
            for word in _LETTERS.findall(clause):
                symbol, weight = lexicon.symbol(word)
                pattern, state = out[state][symbol], after[state][symbol]
                if pattern >= 0:
                    sums[i, pattern] += weight
    return np.minimum(sums, 10 * MOST)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)) // _TOGETHER
        starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
            yield batch.slice(a, b - a)


# ---- model ----


@dataclass(frozen=True)
class ToxicityModel:
    stems: dict[str, float]
    weights: list[float]  # per pattern
    bias: float


def labelled_sample(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, toxic of about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` texts, by a hash of the id. The drawn ids are broadcast."""
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, TOXIC_ROWS / max(1, sizes.get(1, 0))).otherwise(CLEAN_ROWS / max(1, sizes.get(0, 0)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = marked.where(draw < rate).withColumnRenamed("doc_id", "_drawn")
    return documents.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(drawn), F.col("_id") == F.col("_drawn")).select("text", "toxic")


def _count_prefixes(texts: DataFrame, known: set[str] | None) -> DataFrame:
    wanted = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = prefixes(text.as_py() or "")
                sums.update(found if wanted is None else found & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["prefix", "n"])

    return texts.select("text").mapInArrow(count, "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Lexicon and pattern weights from the labelled texts. Counts and features of the bounded sample reach the driver."""
    spark = documents.sparkSession
    ship(spark)
    sample = materialize(labelled_sample(documents, labels))
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    n1, n0 = toxic.count(), clean.count()
    stems: dict[str, float] = {}
    if n1 and n0:
        counted = materialize(_count_prefixes(toxic, None))

        def against_clean(rows: DataFrame) -> dict[str, tuple[int, int]]:
            often = {r["prefix"]: r["n"] for r in rows.collect()}
            rare = {r["prefix"]: r["n"] for r in _count_prefixes(clean, set(often)).collect()}
            return {p: (n, rare.get(p, 0)) for p, n in often.items()}

        counts = against_clean(counted.where(F.col("n") >= TEXTS))
        roots = choose_stems(counts, n1, n0)
        if roots:  # rarer words of the same families
            of_family = reduce(lambda a, b: a | b, [
                F.substring("prefix", 1, size).isin([r for r in roots if len(r) == size]) for size in sorted({len(r) for r in roots})])
            counts |= against_clean(counted.where((F.col("n") >= FAMILY_TEXTS) & of_family))
            stems = choose_stems(counts, n1, n0)
    machine = grammar()
    fixed = [1.0 * (0.2 if "negated" in m else 1) * (0.4 if "reported" in m else 1) * (1.5 if "addressed" in m else 1) for _, m in machine[2]]
    if not (n1 and n0):
        return ToxicityModel(stems, fixed, -4.0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table = Lexicon(stems), grammar()
        for batch in _parts(batches):
            counts = pattern_sums(batch.column(0), lexicon, table)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(counts), pa.list_(pa.float64()))], names=["toxic", "counts"])

    seen = sample.select("text", "toxic").mapInArrow(look, "toxic int, counts array<double>").groupBy("toxic", "counts").agg(F.count(F.lit(1)).alias("n")).toPandas()
    x = np.array(seen["counts"].tolist())
    rows = np.repeat(np.arange(len(seen)), seen["n"])
    # fixed weights are the prior of patterns that the labels do not hold
    weight, bias = _logistic(x[rows], seen["toxic"].to_numpy()[rows])
    held = x[rows].sum(axis=0) > 0
    return ToxicityModel(stems, [float(w) if h else f for w, h, f in zip(weight, held, fixed, strict=True)], bias)


def score(documents: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``score`` in 0..1. Only the text enters it."""
    ship(documents.sparkSession)
    stems, weights, bias = model.stems, np.array(model.weights), model.bias

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, table = Lexicon(stems), grammar()
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
            found = [pattern_sums(b.column(0), lexicon, table) for b in _parts([batch])]
            counts = np.concatenate(found) if found else np.zeros((0, len(weights)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(counts @ weights + bias, -30, 30))))

    return documents.select(*keep, rate(F.col(text).cast("string")).alias("score"))
