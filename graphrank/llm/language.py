"""Language identification: multinomial naive Bayes over hashed character n-grams.

Only letters count: they are lower-cased, every run of other characters is one
word break. The n-grams of 1 to ``MAX_ORDER`` characters are hashed into ``BUCKETS``
buckets; the model is one matrix of log probabilities, bucket x language, of which
``4 * BUCKETS`` bytes a language are broadcast. Batches are scored as sparse count
rows: gather the matrix rows of all features, add them up per document.

Cases: a null text or one without a letter is ``und`` with score 0; a null language
is no label; ties go to the smaller language name; repeated rows are scored alike;
without any label every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.llm.common import crc_share, lean, pieces, ship, text_parts

BUCKETS = 1 << 15
MAX_ORDER = 3
UNKNOWN = "und"
#: Distinct texts per language that fit the model, about; which ones is decided by a hash of text and language.
FIT_ROWS = 4096
#: Characters whose n-grams are held at once.
_CHARS = 1 << 18
#: Cells of the matrix that is broadcast (64 MB): many languages get fewer buckets each, ``LEAST_BUCKETS`` at least.
CELLS, LEAST_BUCKETS = 1 << 24, 512
#: Columns of the matrix that are gathered together, and cells of scores that are held.
_COLUMNS, _SCORES = 16, 1 << 22

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        for i, c in enumerate(map(chr, range(start, stop)), start):
            if c.isalpha():
                table[i] = ord(c.lower()[0])
    return table


def features(texts: list[str], buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order (hashed n-grams of all texts in a row, start of each text): columns and row starts of a sparse matrix."""
    # one line feed before each text and one at the end
    raw = np.frombuffer("\n".join(["", *[t.replace("\n", " ") for t in texts], ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    first = raw == 10
    code = _letters()[raw]
    keep = code > 0
    keep[1:] |= code[:-1] > 0  # one break after a word
    keep |= first
    starts = (np.cumsum(keep) - 1)[np.flatnonzero(first)[:-1]]
    code = code[keep]
    out = []
    mixed = np.zeros(len(code), dtype=np.uint32)
    for order in range(MAX_ORDER):
        shifted = np.zeros_like(code)
        shifted[: len(code) - order] = code[order:]
        mixed = (mixed ^ shifted) * _MULTIPLIERS[order] + np.uint32(order + 1)
        # an n-gram may begin or end with a word break, but holds none inside
        inside = code[order // 2 :] if order != 1 else code
        valid = np.zeros(len(code), dtype=bool)
        valid[: len(inside)] = inside > 0
        if order == 1:
            valid |= shifted > 0
        place = np.flatnonzero(valid)
        scrambled = mixed[place]
        scrambled = (scrambled ^ (scrambled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(((scrambled >> np.uint32(12)) % np.uint32(buckets), np.searchsorted(place, starts)))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # bucket x language
    log_prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, score) per text. Orders overlap, so evidence counts 1 / MAX_ORDER."""
        most = max(1, _SCORES // max(1, len(self.languages)))
        if len(texts) > most:
            parts = [self.score(texts[at : at + most]) for at in range(0, len(texts), most)]
            return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        total = np.zeros((len(texts), len(self.languages)))
        known = np.zeros(len(texts), dtype=bool)
        for index, starts in features(texts, len(self.log_probability)):
            full = np.flatnonzero(np.diff(np.append(starts, len(index))))
            if len(full) and self.languages:
                for at in range(0, len(self.languages), _COLUMNS):
                    some = slice(at, at + _COLUMNS)
                    total[full, some] += np.add.reduceat(self.log_probability[:, some][index], starts[full], axis=0)
                known[full] = True
        if not known.any():
            return np.full(len(texts), -1), np.zeros(len(texts))
        total = total / MAX_ORDER + self.log_prior
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return np.where(known, best, -1), np.where(known, share[np.arange(len(texts)), best], 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS, buckets: int = BUCKETS, smoothing: float = 0.1) -> LanguageModel:
    """Count n-grams per language over about ``rows`` distinct texts of each language.

    Texts are drawn by a hash of the text, at the rate ``rows`` / (distinct texts of the
    language), and each counts once however many copies it has. Priors come from all rows. Only bucket counts reach the driver.
    """
    spark = labelled.sparkSession
    ship(spark)
    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    languages = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    found = languages.limit(CELLS // LEAST_BUCKETS + 1).collect()
    sizes = {r["lang"]: r["n"] for r in found}
    if len(sizes) > CELLS // LEAST_BUCKETS:
        raise ValueError(f"more than {CELLS // LEAST_BUCKETS} values of {lang}: these are no languages")
    buckets = min(buckets, CELLS // max(1, len(sizes)))
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((buckets, 0), dtype=np.float32), np.zeros(0))
    rates = spark.createDataFrame([(r["lang"], rows / max(1, r["texts"])) for r in found], "lang string, rate double")
    draw = F.pmod(F.xxhash64("text", "lang", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text", F.xxhash64("text").alias("hash")).dropDuplicates(["lang", "hash"]).select("lang", "text")

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text", _CHARS):
            for name, group in batch.groupby("lang"):
                for index, _ in features(list(group["text"]), buckets):
                    sums[name] = sums.get(name, 0) + np.bincount(index, minlength=buckets)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": n[at]})

    counted = (
        drawn.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    matrix = np.full((buckets, len(names)), smoothing)
    column = {n: i for i, n in enumerate(names)}
    if len(counted):
        matrix[counted["bucket"].to_numpy(), counted["lang"].map(column).to_numpy()] += counted["n"].to_numpy()
    sizes_of = np.array([sizes[n] for n in names], dtype=float)
    return LanguageModel(names, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(sizes_of / sizes_of.sum()))


def _identifier(documents: DataFrame, model: LanguageModel):
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from lean(named)(parts)

    def named(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in parts:
            found = [known.score(list(batch["text"])) for batch in pieces([pd.DataFrame({"text": texts})], "text", _CHARS)]
            number = np.concatenate([f[0] for f in found]) if found else []
            names = pd.Series([known.languages[i] if i >= 0 else UNKNOWN for i in number], dtype=object)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate([f[1] for f in found]) if found else np.empty(0)})

    return identify


def predict(documents: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred and score, one row per row. Only the text enters the score."""
    identify = _identifier(documents, model)
    return documents.select(*keep, identify(F.col(text).cast("string")).alias("_found")).select(*keep, "_found.lang_pred", "_found.score")


def accepted(documents: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, in all their columns, whose language is known with a score of ``least`` or more; with a letter if the model has no language."""
    if not model.languages:
        return documents.where(F.col(text).cast("string").rlike("\\p{L}"))
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text)

    @lean
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            texts = whole.column(place).cast(pa.string())
            for part in text_parts(pa.RecordBatch.from_arrays([texts, pa.array(range(len(texts)), pa.int64())], names=["text", "at"]), 0, _CHARS):
                number, score = known.score([t or "" for t in part.column(0).to_pylist()])
                keep = part.column(1).filter(pa.array((number >= 0) & (score >= least)))
                if len(keep):
                    yield whole.take(keep)

    return documents.mapInArrow(pick, documents.schema)


def held_out(doc_id: Column) -> Column:
    """True for the documents of which nothing is learned."""
    return crc_share(doc_id, 5) == 0
