"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrank.plans.lineage import materialize, shuffle_partitions

#: The white space of the contracts: space, tab, LF, VT, FF, CR.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

__all__ = ["SPACES", "SPACE_PATTERN", "WORD_PATTERN", "ascii_lower", "crc_share", "lean", "materialize", "numbered_words", "pieces",
           "ship", "shuffle_partitions", "text_parts", "words"]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Array of words; empty for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def crc_share(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, for the functions that run there.

    Spark copies the archive from the driver; executors need no installed copy.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def pieces(batches: Iterable[pd.DataFrame], text: str, chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Cut batches so that each part has about ``chars`` characters, or one row of more.

    Arrow hands over thousands of rows at once; arrays over all their characters
    would not be bounded when texts are long. Null texts become empty ones.
    """
    for batch in batches:
        batch[text] = batch[text].fillna("")
        if batch.empty:
            continue
        part = (batch[text].str.len().cumsum() // chars).to_numpy()
        if part[-1] == 0:
            yield batch
        else:
            for _, rows in batch.groupby(part, sort=False):
                yield rows


def text_parts(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of about ``size`` bytes in the given column, or one row of more. Null values count nothing."""
    group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)) // size
    _, first, n = np.unique(group, return_index=True, return_counts=True)
    for at, rows in zip(first.tolist(), n.tolist(), strict=True):
        yield batch.slice(at, rows)


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts in a row, words per text). Null texts have none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    sizes = np.diff(before[offsets - offsets[0]])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), sizes


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, whose task gives its memory back at the end.

    Python workers live on for the next tasks, and two kinds of functions have workers of their own: what the
    allocators keep of a task's arrays counts against the executor as long as they do.
    """
    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim is not None:
                trim(0)

    return run
