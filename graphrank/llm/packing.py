"""Best-fit packing by exact complements.

Documents are tokenized, ended by one id and cut into pieces. All that packing needs to
know is how many pieces there are of each length, at most ``capacity`` numbers, whatever
the corpus is. On that histogram the plan is made: longest pieces first, the gap that is left is
filled exactly by one, two or three lengths that are still available, as often as their
counts allow; the rest goes to the fullest sequence it fits into. The plan is a short list of
(length, range of numbers, sequence, offset); pieces are numbered per length in parallel
and look up their place.

Cases: a null or empty text is the ending id alone; a document longer than ``capacity`` is
cut, and its full pieces are sequences of their own; repeated rows are documents of their own;
null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphrank.llm.common import lean, materialize, ship, shuffle_partitions

#: Words, and stems of words, whose ids a task remembers, and the longest of them: some 140 MB at most.
_WORDS, _STEMS, _LONGEST = 1 << 17, 1 << 19, 48
#: Characters of text that are tokenized together.
_TOGETHER = 1 << 21
#: What a Python worker holds: the tokenizer, and the words of the task that runs.
_worker: dict = {}


def _encode_stems(new: list[str], stems: dict[str, bytes]) -> None:
    """Add the ids of stems. Stems of letters alone are one run each, whose last id is marked as a word's end, so many go in one call."""
    tokenizer, is_end = _worker["tokenizer"], _worker["is_end"]
    runs = [s for s in new if s.isalpha() and max(s) < "\u0100"]
    for at in range(0, len(runs), 50_000):
        some = runs[at : at + 50_000]
        found = tokenizer.encode_batch_fast([" ".join(some[k : k + 250]) for k in range(0, len(some), 250)], add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, dtype="<u4") for f in found])
        ends = ((np.flatnonzero(is_end[ids]) + 1) * 4).tolist()
        whole, begin = ids.tobytes(), 0
        if len(ends) != len(some):
            raise ValueError("the tokenizer does not mark the ends of words")
        for stem, end in zip(some, ends, strict=True):
            stems[stem] = whole[begin:end]
            begin = end
    known = set(runs)
    others = [s for s in new if s not in known]
    for at in range(0, len(others), 10_000):
        some = others[at : at + 10_000]
        for stem, found in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            stems[stem] = np.array(found.ids, dtype="<u4").tobytes()


def token_ids(texts: pa.Array, definition: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids per text), without special tokens of its own; null is empty.

    White space ends tokens and is no token, so a text's ids are those of its words in a row. Words come again, so a
    worker remembers the ids of words and of their stems: the word in lower case, without a point or comma that follows
    a letter. Only Latin-1 words are lower-cased here, of which every library has the same small letters.
    """
    if _worker.get("definition") != definition:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        tokenizer = Tokenizer.from_str(definition)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix") or "\0"
        is_end = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        is_end[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        _worker.update(definition=definition, tokenizer=tokenizer, is_end=is_end, words={}, stems={})
    words, stems = _worker["words"], _worker["stems"]
    if len(words) > _WORDS:
        words.clear()
    if len(stems) > _STEMS:
        stems.clear()
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    new_words = [w for w in distinct if w not in words]
    bases, ends = [], []
    for word in new_words:
        last = word[-1:]
        if (last == "," or last == ".") and "A" <= word[-2:-1] < "\u0100" and word[-2].isalpha():
            word = word[:-1]
            ends.append(last)
        else:
            ends.append("")
        bases.append(word.lower() if word.isascii() or max(word) < "\u0100" else word)
    new = [s for s in {*bases, *ends} if s and s not in stems]
    stems[""] = b""
    _encode_stems(new, stems)
    for word, base, end in zip(new_words, bases, ends, strict=True):
        words[word] = stems[base] + stems[end] if end else stems[base]
    known = [words[w] for w in distinct]
    flat = np.frombuffer(b"".join(known), dtype="<u4")
    length = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
    for word in [w for w in new_words if len(w) > _LONGEST]:
        del words[word]
    for stem in [s for s in new if len(s) > _LONGEST]:
        del stems[stem]

    index = coded.indices.to_numpy()
    per_word = length[index]
    upto = np.concatenate([[0], np.cumsum(per_word)])
    begin = (np.cumsum(length) - length)[index] - upto[:-1]
    ids = flat[np.repeat(begin, per_word) + np.arange(upto[-1])]
    bounds = split.offsets.to_numpy().astype(np.int64)
    return ids, np.diff(upto[bounds - bounds[0]])


def tokenized_pieces(documents: DataFrame, definition: str, capacity: int, end_id: int = 0,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document, at most ``capacity`` ids each."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(definition)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            texts = batch.column(1)
            group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // _TOGETHER
            _, starts, counts = np.unique(group, return_index=True, return_counts=True)
            for first, n in zip(starts.tolist(), counts.tolist(), strict=True):
                ids, sizes = token_ids(texts.slice(first, n), shared.value)
                whole, at = ids.tobytes(), 0
                for i, size in enumerate(sizes.tolist(), first):
                    document = whole[at : at + 4 * size] + end
                    at += 4 * size
                    for k, begin in enumerate(range(0, len(document), 4 * capacity)):
                        part = document[begin : begin + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            number = np.array(piece, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from pieces_of(batches)
        finally:  # workers live on after a task; its words would stay in their memory
            for known in (_worker.get("words"), _worker.get("stems")):
                if known:
                    known.clear()

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many of this kind) from the number of pieces per length.

    Gaps are filled by up to three lengths; where few lengths are left, fewer may leave better rests, so the
    shortest of the plans with three, two and one is taken.
    """
    plans = [_plan(histogram, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            patterns.append((lengths, times))
        return bool(times)

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        """Available (a, b), a >= b, of sum ``total``, the largest a first."""
        high = min(most, total - 1)
        low = (total + 1) // 2
        if high >= low >= 1:
            a = np.arange(high, low - 1, -1)
            for x in a[(left[a] > 0) & (left[total - a] > 0)]:
                yield int(x), int(total - x)

    if left[capacity]:
        use((capacity,))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if left[length] and gap <= length:
            use((length, gap))
        for a, b in pairs(gap, length) if left[length] and most > 1 else ():
            use((length, a, b))
            if not left[length]:
                break
        if left[length] and most > 2:
            for a in np.flatnonzero(left[: min(gap - 1, length + 1)])[::-1]:
                for b, c in pairs(gap - int(a), int(a)):
                    use((length, int(a), b, c))
                    if not left[length] or not left[a]:
                        break
                if not left[length]:
                    break

    # best fit of the rest: kinds of open sequences by the gap they have
    gaps: dict[int, list[list]] = {}
    for length in np.flatnonzero(left)[::-1]:
        length, n = int(length), int(left[length])
        while n:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                per = min(capacity // length, n)
                times = n // per
                lengths, rest = (length,) * per, capacity - per * length
            else:
                lengths, times = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                fits = min(gap // length, n)
                if fits * times > n:  # some of this kind stay as they are
                    fits = max(1, min(fits, n // times)) if n >= times else min(fits, n)
                    used = min(times, n // fits)
                    if times > used:
                        gaps.setdefault(gap, []).append([lengths, times - used])
                    times = used
                per, lengths, rest = fits, lengths + (length,) * fits, gap - fits * length
            n -= per * times
            gaps.setdefault(rest, []).append([lengths, times])
    return patterns + [(lengths, times) for kinds in gaps.values() for lengths, times in kinds]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, end of numbers, sequence of the first, offset): pieces of a length in the order of their numbers."""
    out, used, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            out.append((length, first, first + times, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return out


def numbered(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Add ``_number``: 0, 1, 2, ... among the pieces of a length.

    A length with many pieces is cut into hash groups of about equal size; there are at most
    4 x shuffle partitions + lengths groups, whose counts the driver adds up.
    """
    spark = pieces.sparkSession
    group_rows = max(1, -(-sum(histogram.values()) // (4 * shuffle_partitions(spark))))
    parts = spark.createDataFrame([(n, -(-c // group_rows)) for n, c in histogram.items()], "length long, _parts long")
    grouped = pieces.join(F.broadcast(parts), "length").withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), "_parts")).drop("_parts")
    counts = {(r["length"], r["_group"]): r["n"] for r in grouped.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [], {}
    for length, group in sorted(counts):
        offsets.append((length, group, before.get(length, 0)))
        before[length] = before.get(length, 0) + counts[length, group]
    known = spark.createDataFrame(offsets, "length long, _group long, _offset long")
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = grouped.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(known), ["length", "_group"]).withColumn("_number", F.col("_offset") + F.col("_rank")).drop("_offset", "_rank", "_group")


def pack(documents: DataFrame, definition: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = documents.sparkSession
    pieces = materialize(tokenized_pieces(documents, definition, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = [*pieces.columns]
    table = spark.createDataFrame(
        places(plan(histogram, capacity)), "length long, _first long, _end long, _sequence long, offset long")
    # the plan is bounded by the capacity, not by the data
    return numbered(pieces, histogram).join(F.broadcast(table), "length").where(
        (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_end"))
    ).select(*columns, (F.col("_sequence") + F.col("_number") - F.col("_first")).alias("sequence_id"), "offset")
