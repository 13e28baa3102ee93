"""From raw documents to packed training sequences: each stage reads what the stage before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrank.llm import jaccard, language, line_dedup, mixing, packing
from graphrank.llm.queries import MIX, tokenizer_definition
from graphrank.llm.registry import read
from graphrank.plans.lineage import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go. The model learns from the labels of ``docs``."""
    return language.accepted(docs, language.fit(docs))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of ten documents or more stays in the first of them only; a document left without a word goes."""
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, keep_first=True))
    left = cut.where((F.col("n_dropped") == 0) | F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.select(*[
        F.when(F.col("n_dropped") > 0, changed[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in changed else F.col(f"row.{c}")
        for c in docs.columns
    ])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five words, linked at a similarity of 0.8."""
    return jaccard.representatives(docs, jaccard.Rule(size=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.training_order(mixing.mix(docs, keep=docs.columns, **MIX))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and the offset there."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_definition())


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models, compressed bitmaps and a tokenizer have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with Workspace(spark) as work:  # what a stage stores on its way goes when its result is written
            docs = work.hand_on(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
