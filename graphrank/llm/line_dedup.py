"""Line dedup by a range-partitioned stream of line hashes.

Every line becomes (128-bit hash of its key, document, position). The hashes are
range-partitioned together with the document, so even a line of every document is
spread over tasks, and sorted by document and position inside a task. One pass over
the sorted rows sees each line's occurrences one after another. A run of equal hashes
that touches the edge of a task may go on in the next one; its count is added up
from one summary row per edge. The result is no text: per document that loses lines
one compressed bitmap of the lines to keep.

Cases: a null or empty text is one empty line; lines whose key is shorter than
``min_chars`` always stay; a key twice in one document counts as one document; rows
that repeat a doc_id count as one document, and each row gets the bitmap of its own
text; null ids are one document; ties do not matter, equal rows have equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.llm.common import SPACES, ascii_lower, lean, materialize, ship, shuffle_partitions

_DROP, _OPEN, _EDGE = 0, 1, 2
_FIELDS = ("h1", "h2", "no_id", "id", "version", "pos")
_SCHEMA = "kind int, h1 long, h2 long, no_id int, id long, version long, pos int, n_docs long"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(doc_id: str, text: str) -> list[Column]:
    """The identity of a row: whether the id is null, the id, and a hash of the text."""
    return [
        F.col(doc_id).isNull().cast("int").alias("no_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.lit(2), F.coalesce(F.col(text), F.lit(""))).alias("version"),
    ]


def _stream(min_docs: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None  # rows of the run that is not over
        seen = 0  # documents of that run whose rows have left the carry
        last: tuple | None = None  # its last document among those
        started = False  # the first run of the task is over
        first_of_run: tuple | None = None

        def out(kind: int, rows: list[np.ndarray], n_docs: np.ndarray | int = 0) -> pa.RecordBatch:
            n = len(rows[0])
            columns = [np.full(n, kind, dtype=np.int32), *rows, np.broadcast_to(np.asarray(n_docs, dtype=np.int64), n)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["kind", *_FIELDS, "n_docs"])

        def take(rows: list[np.ndarray], where) -> list[np.ndarray]:
            return [r[where] for r in rows]

        def decided(rows: list[np.ndarray], first: tuple, first_run: bool) -> Iterator[pa.RecordBatch]:
            """Rows of a common line. The first occurrence, also when its row is repeated, may stay."""
            if keep_first:
                own = np.logical_and.reduce([r == v for r, v in zip(rows, first, strict=True)])
                if first_run and own.any():
                    yield out(_OPEN, take(rows, own))
                rows = take(rows, ~own)
            if len(rows[0]):
                yield out(_DROP, rows)

        def edge(rows: list[np.ndarray], docs: int, first_run: bool) -> Iterator[pa.RecordBatch]:
            """A run at the edge of the task that is over now; ``rows`` are those not yet handed out."""
            head = first_of_run or tuple(r[0] for r in rows)
            if len(rows[0]):
                if docs >= min_docs:
                    yield from decided(rows, head, first_run)
                else:
                    yield out(_OPEN, rows)
            yield out(_EDGE, [np.array([v], dtype=r.dtype) for v, r in zip(head, rows, strict=True)], docs)

        for batch in batches:
            rows = [batch.column(f).to_numpy(zero_copy_only=False) for f in _FIELDS]
            if not len(rows[0]):
                continue
            if carry is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(carry, rows, strict=True)]
            h1, h2, no_id, ids = rows[:4]
            new_run = np.empty(len(h1), dtype=bool)
            new_run[0] = True
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (ids[1:] != ids[:-1]) | (no_id[1:] != no_id[:-1])
            starts = np.flatnonzero(new_run)
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            if seen:  # the first run here goes on with what has been handed out
                same = first_of_run is not None and (h1[0], h2[0]) == first_of_run[:2]
                if same:
                    docs[0] += seen - ((no_id[0], ids[0]) == last)
                else:  # it ended exactly at the end of the last batch
                    if not started:
                        yield from edge(take(rows, slice(0, 0)), seen, True)
                        started = True
                    seen, first_of_run, last = 0, None, None
            ends = np.append(starts[1:], len(h1))
            at = 0
            if len(starts) > 1 and not started:
                yield from edge(take(rows, slice(0, ends[0])), int(docs[0]), True)
                started, at, seen, first_of_run = True, 1, 0, None
            elif len(starts) > 1 and seen:
                if docs[0] >= min_docs:
                    yield from decided(take(rows, slice(0, ends[0])), first_of_run, False)
                at, seen, first_of_run = 1, 0, None
            if len(starts) - 1 > at:  # runs inside the task
                begin, stop = starts[at], starts[-1]
                run_of = np.repeat(np.arange(at, len(starts) - 1), (ends - starts)[at:-1])
                drop = docs[run_of] >= min_docs
                if keep_first:
                    lead = starts[run_of]
                    drop &= ~np.logical_and.reduce([r[begin:stop] == r[lead] for r in rows])
                if drop.any():
                    yield out(_DROP, take(rows, begin + np.flatnonzero(drop)))
            carry = take(rows, slice(starts[-1], None))
            carried = int(docs[-1])
            if carried >= min_docs:  # decided: hand the rows out, a common line is never gathered
                if first_of_run is None:
                    first_of_run = tuple(r[0] for r in carry)
                yield from decided(carry, first_of_run, not started)
                seen, last = carried, (carry[2][-1], carry[3][-1])
                carry = take(carry, slice(0, 0))
        if carry is not None:
            rows = carry
            docs = seen
            if len(rows[0]):
                new_doc = np.ones(len(rows[0]), dtype=bool)
                new_doc[1:] = (rows[3][1:] != rows[3][:-1]) | (rows[2][1:] != rows[2][:-1])
                docs = seen + int(new_doc.sum())
            yield from edge(rows, docs, not started)

    return run


def keep_bitmaps(documents: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bitmaps of the documents that lose lines: no_id, id, version, n_dropped, keep.

    A line goes if its key is in ``min_docs`` documents or more; with ``keep_first`` its first
    occurrence by document and position stays. ``keep`` is zlib over big-endian bits, 1 for a line
    that stays; lines after the last bit stay.
    """
    spark = documents.sparkSession
    ship(spark)
    lines = (
        documents.select(*_document(doc_id, text), F.posexplode(F.transform(_lines(F.col(text)), line_key)).alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64(F.lit(0), "key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "no_id", "id", "version", "pos")
    )
    ranged = lines.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "no_id", "id")
    found = materialize(ranged.sortWithinPartitions(*_FIELDS).mapInArrow(lean(_stream(min_docs, keep_first)), _SCHEMA))
    edges = (
        found.where(F.col("kind") == _EDGE).groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("_docs"), F.min(F.struct("no_id", "id", "version", "pos")).alias("_first"))
        .where(F.col("_docs") >= min_docs)
    )
    still_open = found.where(F.col("kind") == _OPEN).join(edges, ["h1", "h2"])
    if keep_first:
        still_open = still_open.where(F.struct("no_id", "id", "version", "pos") != F.col("_first"))
    place = ["no_id", "id", "version", "pos"]
    dropped = found.where(F.col("kind") == _DROP).select(*place).unionByName(still_open.select(*place))

    def one(places) -> bytes:
        keep = np.ones((max(places) // 8 + 1) * 8, dtype=bool)
        keep[np.asarray(places)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    @F.pandas_udf("binary")
    def bitmap(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(lambda all_: (positions.map(one) for positions in all_))(parts)

    # a group is the lines of one document
    return dropped.groupBy("no_id", "id", "version").agg(F.collect_set("pos").alias("_places")).select(
        "no_id", "id", "version", F.size("_places").cast("long").alias("n_dropped"), bitmap("_places").alias("keep"))


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: row (all columns of the input), kept (text of the lines that stay), n_lines, n_dropped."""
    ship(documents.sparkSession)

    def one(whole, packed):
        if packed is None:
            return None
        lines = whole.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))
        return "\n".join(line for i, line in enumerate(lines) if i >= len(keep) or keep[i])

    @F.pandas_udf("string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from lean(lambda all_: (
            pd.Series([one(t, b) for t, b in zip(texts, bitmaps, strict=True)], dtype=object) for texts, bitmaps in all_))(parts)

    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col(text).alias("_text"), *_document(doc_id, text))
    joined = rows.join(bitmaps, ["no_id", "id", "version"], "left")
    changed = F.when(F.col("keep").isNotNull(), F.col("_text"))
    return joined.select(
        "row",
        F.when(F.col("keep").isNull(), F.coalesce(F.col("_text"), F.lit(""))).otherwise(cut(changed, "keep")).alias("kept"),
        F.size(_lines(F.col("_text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
    )
