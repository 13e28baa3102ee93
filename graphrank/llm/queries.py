"""The registered queries: each operator over its whole table, in the columns of its contract."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrank.llm import ann, html_extract, jaccard, language, licenses, line_dedup, lm, mixing, packing, periodic, quality, spelling, toxicity
from graphrank.llm.common import crc_share, materialize
from graphrank.llm.attention import END
from graphrank.llm.registry import query, read
from graphrank.llm.sql import OP2, OP5
from graphrank.llm.subwords import Subwords

#: Weights of the mix by place of the source, their change until the end of training, words to take, most passes.
MIX = {"weights": (5, 2, 1), "tilt": (-0.5, 0.0, 0.5), "share": 1.5, "passes": 2.0}
TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_definition(name: str = TOKENIZER) -> str:
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query(OP2)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(documents, min_docs=10, keep_first=False)
    return line_dedup.apply_bitmaps(documents, bitmaps).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = language.held_out(F.col("doc_id"))
    model = language.fit(documents.where(~apart))
    return language.predict(documents, model, ["doc_id"]).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


@query(OP5)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"], **MIX)
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_definition())


@query()
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(read(spark, sf_dir, "documents"), jaccard.Rule(size=4, percent=85))


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.vectors_of(read(spark, sf_dir, "embeddings"))
    index = materialize(ann.build_index(rows))
    return ann.search(index, rows.where("id % 100 = 0"), k=10)


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    apart = crc_share(F.col("doc_id"), 4) == 2
    model = toxicity.fit(documents, read(spark, sf_dir, "labels").where(~apart))
    scored = toxicity.score(documents, model, ["doc_id"])
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.fit(pages), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(read(spark, sf_dir, "documents"))


@query()
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    subwords = Subwords.read(public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END)
    found = lm.score_documents(read(spark, sf_dir, "documents"), crc_share(F.col("doc_id"), 10) != 0, subwords)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(read(spark, sf_dir, "documents"), planted=True).drop("runs")


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(read(spark, sf_dir, "documents"), least_letters=6, least_n=5, slips=199)
    return spelling.variants(words, factor=5).select("word", "form", "root", "n", "n_near", "form_n")
