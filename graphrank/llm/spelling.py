"""Spelling variants: words one edit apart, found by permuterm rotations.

A word of L letters is marked with a terminator, ``word$``, and stands in the table of rotations once for each
of its L + 1 full rotations, and once for each letter that an edit may change: the rotation that ends with that
letter, without it. The rotations are range-partitioned and sorted. Rows with an equal key are then one group:

* two words whose keys skip a letter differ in that letter only (replacement);
* a full rotation equal to such a key is the word without that letter (insertion, deletion).

A group has one word per letter of the alphabet and one full rotation at most, so no group grows with the data.
No pair is ever built: each row of a group needs the number of the others and the best of them, which is the first row of the group
by falling count, or the second for that first row itself. A pair meets in one group only, but where a letter is deleted from
a stretch of equal letters; of these the first one counts.

Cases: a null text has no words; a null doc_id leaves its words as they are; repeated rows count
again; ties of a form go to the smaller word in code-point order; words of any length are whole; an empty table gives an
empty result. Other columns of the documents, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrank.llm.common import ascii_lower, materialize
from graphrank.plans.lineage import Rounds

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Sorts before all letters and is none.
END = "$"


def planted_slip(doc_id: Column, word: Column, every: int = 199) -> Column:
    """``word`` without one letter where ``every`` divides the crc32 of ``doc_id:word``."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def word_counts(documents: DataFrame, least_letters: int = 6, least_n: int = 5, slips: int | None = None,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters of whole texts. ``slips`` plants one in so many (see ``planted_slip``)."""
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(LETTERS), 0)
    # nothing makes a word longer, so shorter ones go before any work on them
    long_runs = documents.select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("run")).where(F.char_length("run") >= least_letters)
    lowered = long_runs.select("doc_id", ascii_lower(F.col("run")).alias("word"))
    if slips is not None:
        lowered = lowered.select(planted_slip(F.col("doc_id"), F.col("word"), slips).alias("word")).where(F.char_length("word") >= least_letters)
    return lowered.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, skipped, first): ``skipped`` is false for full rotations; ``first`` is true for the first of equal letters in a row."""
    size = F.char_length("word")

    def rotation(i: Column, gap: int) -> Column:
        """From letter ``i + gap`` to the end, the terminator, and the ``i`` letters before."""
        return F.concat(F.substring("word", i + gap + 1, size), F.lit(END), F.substring("word", F.lit(1), i))

    def letter(i: Column) -> Column:
        return F.substring("word", i + 1, F.lit(1))

    full = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        rotation(i, 0).alias("key"), F.lit(False).alias("skipped"), F.lit(False).alias("first")))
    edited = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        rotation(i, 1).alias("key"), F.lit(True).alias("skipped"), ((i == 0) | (letter(i - 1) != letter(i))).alias("first")))
    return words.select("word", "n", F.explode(F.concat(full, edited)).alias("_r")).select("_r.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): the number of words one edit away and the most frequent of them as (n, word)."""
    rows = rotations(words).repartitionByRange("key")
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    name = F.struct(F.col("n"), F.col("word"))
    scanned = rows.select(
        "key", "word", "n", "skipped", "first",
        F.count(F.lit(1)).over(ranked).alias("_rows"),
        F.count(F.when(F.col("skipped"), 1)).over(ranked).alias("_edited"),
        F.count(F.when(F.col("first"), 1)).over(ranked).alias("_deleted"),
        F.first(name).over(ranked).alias("_best"), F.nth_value(name, 2).over(ranked).alias("_next"),
    ).where("_rows > 1")
    shorter = F.col("_rows") > F.col("_edited")  # the full rotation is in the group
    near = F.when(~F.col("skipped"), F.col("_deleted")).otherwise(F.col("_edited") - 1 + F.when(shorter & F.col("first"), 1).otherwise(0))
    best = F.when(F.col("_best.word") == F.col("word"), F.col("_next")).otherwise(F.col("_best"))
    found = scanned.select("word", F.lit(None).cast("long").alias("n"), near.alias("near"), F.struct((-best["n"]).alias("less"), best["word"].alias("word")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return found.unionByName(alone).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("_least")
    ).select("word", "n", "n_near", F.struct((-F.col("_least.less")).alias("n"), F.col("_least.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each word's form of a form, to the last. Steps double, so rounds are few."""
    rounds = Rounds()
    known = rounds.store(forms.select("word", F.col("form").alias("root")))
    while True:
        ends = known.select(F.col("word").alias("_word"), F.col("root").alias("_further"))
        moved = known.join(ends, known["root"] == ends["_word"], "left").select(
            "word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved"))
        stored = rounds.store(moved)
        known = stored.drop("_moved")
        if stored.where("_moved").isEmpty():
            return known


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n). The form is the best neighbour if ``factor`` times as frequent."""
    words = materialize(words)
    is_form = F.col("best.n") >= factor * F.col("n")
    found = materialize(neighbours(words).select(
        "word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
