"""Exact Jaccard self join of word n-gram sets, by vertical partitioning, and its connected components.

All n-grams stand in one global order: rare ones by hash, then those known to be frequent. An n-gram is
a 63-bit hash whose sign says whether it is frequent, so the order of the numbers is the global order.

1. Texts with equal sets are one class. Everything below works on one member of each class.
2. Frequent n-grams are found by counting fingerprints of a quarter of the hash range over all documents.
   They decide the order only; any set gives the same links.
3. A set's prefix is so long that two sets with a link share an n-gram of their prefixes. Prefix
   n-grams are range-partitioned with their documents and streamed; each run of equal n-grams
   gets a pivot, the document with the fewest rare n-grams. Documents with the same pivot are a group.
4. Documents are compared with their pivots first: a large group of copies is joined by one link per member.
   Then each member that its pivot did not reach is compared with the members of other components: in small groups
   pair by pair, in large ones block by block, where a task puts out links only. Length, position and prefix
   bounds remove pairs that cannot reach the threshold.
5. The global order is cut into fragments. Overlaps are counted for each fragment apart and summed per
   pair: the exact intersection.

Sets are compared as 63-bit hashes, classes and fragments likewise. Words are runs of characters
other than the six white spaces, A-Z lower-cased; a text with fewer words than ``size`` is one n-gram.

Cases: a null text or one without a word has the empty set, links with nothing and is its own
component; repeated rows of one id are one document, and if their texts differ, links of either are its own;
a null id is never the name of a component unless all members have none; ties go to the smaller hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrank.llm.common import lean, materialize, ship, shuffle_partitions
from graphrank.llm.components import components

#: Characters that are hashed together, and n-grams of a task that are counted together.
_CHARS, _COUNTED = 1 << 20, 1 << 20
#: Fragments of the global order.
FRAGMENTS = 8
#: Groups of more members are compared block by block, of about so many documents.
SMALL, BLOCK = 64, 512
#: Hashes do not repeat: no dictionary is tried when they are stored.
PLAIN = {"parquet.enable.dictionary": "false"}
#: Bits of the bitmaps of documents: 8 MB.
BITMAP_BITS = 1 << 26
#: The part of the hash range whose n-grams are counted is 1 / 4: two leading bits are 0.
_COUNTED_BITS = 61
_FREQUENT = np.int64(1) << np.int64(62)


@dataclass(frozen=True)
class Rule:
    """Links need 100 * intersection >= percent * union of sets of ``size`` words."""

    size: int = 4
    percent: int = 85
    #: An n-gram of so many documents or more counts as frequent ...
    frequent: int = 16
    #: ... but only the most frequent ones, as many as this: 8 MB at most are broadcast.
    most_frequent: int = 1 << 20

    def prefix(self, n: int) -> int:
        """n-grams that a set of n must miss in order to lose its last possible link, and one more."""
        return n - (self.percent * n + 99) // 100 + 1

    def reachable(self, overlap: Column, na: Column, nb: Column) -> Column:
        return (100 + self.percent) * overlap.cast("long") >= self.percent * (na + nb).cast("long")


# ---- n-grams of texts, in the tasks ----


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the n-grams of each text."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = split.flatten().dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    word = table[coded.indices.to_numpy()] if len(coded) else np.empty(0, dtype=np.uint64)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
        for k in range(size):
            whole = _mixed(whole + word[k : k + len(whole)] + np.uint64(0x9E3779B97F4A7C15))
        whole >>= np.uint64(1)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(whole[a : b - size + 1]))
            elif b - a == 1 and word[a] == 0:  # the empty text
                out.append(whole[:0])
            else:
                short = np.full(1, b - a, dtype=np.uint64)
                for k in range(a, b):
                    short = _mixed(short + word[k] + np.uint64(0x9E3779B97F4A7C15))
                out.append(short >> np.uint64(1))
    return out


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut so that the texts of a part have about ``_CHARS`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // _CHARS
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            part = batch.slice(a, b - a)
            yield part, part.column(column)


def _node(hashes: np.ndarray) -> int:
    """64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _ordered(hashes: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    """Places in the global order: negative for rare n-grams, else frequent."""
    keys = (hashes >> np.uint64(1)).astype(np.int64) - _FREQUENT
    if len(frequent):
        counted = np.flatnonzero(hashes < np.uint64(1) << np.uint64(_COUNTED_BITS))
        prints = hashes[counted] >> np.uint64(_COUNTED_BITS - bits)
        at = np.minimum(np.searchsorted(frequent, prints), len(frequent) - 1)
        keys[counted[frequent[at] == prints]] += _FREQUENT
    return np.sort(keys)


# ---- sets and frequent n-grams ----


def survey(documents: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """One pass over (text, doc_id): rows (doc_id, n, node) of the sets, and rows of fingerprint counts.

    Fingerprints have ``bits`` bits. A task sends the lower 32 of them, sorted, as one binary value per range (the
    upper bits), those it has seen once apart from those with a count.
    """
    shift, low = np.uint64(_COUNTED_BITS - bits), np.uint64(0xFFFFFFFF)
    limit = np.uint64(1) << np.uint64(_COUNTED_BITS)
    kind = pa.int64()

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, times = np.unique(np.concatenate(held), return_counts=True)
        bucket = (prints >> np.uint64(32)).astype(np.int64)
        rows = []
        for many in (False, True):
            keep = times > 1 if many else times == 1
            p, t, k = prints[keep], times[keep].astype("<u4"), bucket[keep]
            starts = np.flatnonzero(np.diff(k, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(k)], strict=False):
                rows.append((int(k[a]), (p[a:b] & low).astype("<u4").tobytes(), t[a:b].tobytes() if many else None))
        none = pa.nulls(len(rows), kind)
        return pa.RecordBatch.from_arrays(
            [none, none, none, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.binary(), pa.binary())))],
            names=["doc_id", "n", "node", "bucket", "prints", "times"])

    @lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part, texts in _parts(batches, 0):
            sets = ngram_hashes(texts, rule.size)
            nothing = pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array([len(h) for h in sets], kind), pa.array([_node(h) if len(h) else None for h in sets], kind),
                 pa.nulls(len(sets), kind), nothing, nothing], names=["doc_id", "n", "node", "bucket", "prints", "times"])
            for hashes in sets:
                some = hashes[: np.searchsorted(hashes, limit)] >> shift
                held.append(some)
                count += len(some)
            if count > _COUNTED:
                yield flush(held)
                held, count = [], 0
        if count:
            yield flush(held)

    return documents.mapInArrow(look, "doc_id long, n long, node long, bucket long, prints binary, times binary")


def frequent_prints(counts: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted fingerprints of frequent n-grams: a range of fingerprints is added up in one task."""
    least = rule.frequent

    def add(group: pd.DataFrame) -> pd.DataFrame:
        prints = np.concatenate([np.frombuffer(p, dtype="<u4") for p in group["prints"]])
        times = np.concatenate([np.frombuffer(t, dtype="<u4") if t is not None else np.ones(len(p) // 4, dtype="<u4")
                                for p, t in zip(group["prints"], group["times"], strict=True)])
        order = np.argsort(prints, kind="stable")
        prints, times = prints[order].astype(np.int64), times[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(prints, prepend=-1))
        total = np.add.reduceat(times, starts) if len(starts) else times
        keep = total >= least
        return pd.DataFrame({"print": (int(group["bucket"].iloc[0]) << 32) + prints[starts][keep], "n": total[keep]})

    found = materialize(counts.groupBy("bucket").applyInPandas(add, "print long, n long"))
    # the most frequent ones within the bound, in whole classes of about equal counts
    rank = F.floor(F.log2("n") * 8).cast("int")
    classes = sorted(((r["rank"], r["n"]) for r in found.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, lowest = 0, None
    for level, n in classes:
        if total + n > rule.most_frequent:
            break
        total, lowest = total + n, level
    if lowest is None:
        return np.empty(0, dtype=np.uint64)
    return np.sort(found.where(rank >= lowest).select("print").toPandas()["print"].to_numpy(dtype=np.int64).astype(np.uint64))


# ---- bitmaps of documents ----


def _bit(doc_id: Column) -> Column:
    return F.xxhash64(doc_id).bitwiseAND(F.lit(BITMAP_BITS - 1))


def bitmap_of(doc_ids: DataFrame) -> np.ndarray:
    """``BITMAP_BITS`` bits, whatever the number of documents: 1 at the hash of each doc_id.

    It only spares work: a document without its bit is not wanted, one with it is looked up.
    """
    words = doc_ids.select(_bit(F.col("doc_id")).alias("_bit")).select(
        F.shiftright("_bit", 5).alias("word"), F.expr("shiftleft(1L, cast(_bit % 32 AS int))").alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(BITMAP_BITS // 32, dtype="<u4")
    bitmap[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return bitmap.view(np.uint8)


def _chosen(bitmap: np.ndarray, part: pa.RecordBatch) -> pa.Array:
    bit = part.column(2).to_numpy(zero_copy_only=False)
    return pa.array(((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool))


def prefixes_of(documents: DataFrame, classes: DataFrame, rule: Rule, frequent: np.ndarray, bits: int) -> DataFrame:
    """node, n, rare, prefix of one member of each class; prefixes are sorted by the global order, ``rare`` n-grams first."""
    context = documents.sparkSession.sparkContext
    wanted, known = context.broadcast(bitmap_of(classes)), context.broadcast(frequent)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, 0):
            chosen = _chosen(wanted.value, part)
            rows = []
            for hashes in ngram_hashes(texts.filter(chosen), rule.size):
                keys = _ordered(hashes, known.value, bits)[: rule.prefix(len(hashes))] if len(hashes) else hashes.astype(np.int64)
                rows.append((_node(hashes) if len(hashes) else None, len(hashes), int(np.searchsorted(keys, 0)), keys))
            yield pa.RecordBatch.from_arrays(
                [part.column(1).filter(chosen), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))))],
                names=["doc_id", "node", "n", "rare", "prefix"])

    found = documents.mapInArrow(cut, "doc_id long, node long, n int, rare int, prefix array<long>")
    one = classes.select("node", F.col("doc_id").alias("_one"))
    return found.join(one, "node").where(F.col("doc_id").eqNullSafe(F.col("_one"))).select("node", "n", "rare", "prefix").dropDuplicates(["node"])


# ---- runs of equal prefix n-grams ----

_RUN, _OPEN, _EDGE = 0, 1, 2
_ENTRY = ("ngram", "rare", "node", "n", "place")
_RUNS = "kind int, ngram long, rare int, node long, n int, place int, pivot_rare int, pivot long, pivot_n int, pivot_place int, entries long"


@lean
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of n-grams of two entries or more with their pivot; what touches the edge of the task stays open."""
    first: tuple | None = None  # the first entry of the run that is not over
    seen, started = 0, False

    def out(kind: int, rows: list[np.ndarray], pivot: list[np.ndarray], entries: int = 0) -> pa.RecordBatch:
        n = len(rows[0])
        columns = [np.full(n, kind, dtype=np.int32), *rows, *pivot[1:], np.full(n, entries, dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns],
                                          names=["kind", *_ENTRY, "pivot_rare", "pivot", "pivot_n", "pivot_place", "entries"])

    def single(entry: tuple, types: list[np.ndarray]) -> list[np.ndarray]:
        return [np.array([v], dtype=t.dtype) for v, t in zip(entry, types, strict=True)]

    rows: list[np.ndarray] = []
    for batch in batches:
        got = [batch.column(c).to_numpy(zero_copy_only=False) for c in _ENTRY]
        if not len(got[0]):
            continue
        rows = got
        ngram = rows[0]
        goes_on = first is not None and ngram[0] == first[0]
        if first is not None and not goes_on:  # it ended with the last batch
            if not started:
                yield out(_EDGE, single(first, rows), single(first, rows), seen)
            started, first, seen = True, None, 0
        starts = np.flatnonzero(np.diff(ngram, prepend=ngram[0] - 1))
        if goes_on:
            starts = starts[1:] if len(starts) and starts[0] == 0 else starts
            end = int(starts[0]) if len(starts) else len(ngram)
            head = [r[:end] for r in rows]
            own = single(first, rows)
            if not started:
                yield out(_OPEN, head, head)
            else:
                if seen == 1:
                    yield out(_RUN, own, own)
                yield out(_RUN, head, [np.repeat(v, end) for v in own])
            seen += end
            if len(starts) and not started:
                yield out(_EDGE, own, own, seen)
            if len(starts):
                started, first, seen = True, None, 0
        if not len(starts):
            continue
        sizes = np.diff(np.append(starts, len(ngram)))
        at = 0
        if not started:
            head = [r[: starts[0] + sizes[0]] for r in rows]
            yield out(_OPEN, head, head)
            at = 1
            if len(starts) > 1:
                one = [r[:1] for r in rows]
                yield out(_EDGE, one, one, int(sizes[0]))
                started = True
        if len(starts) > at:
            # a last run of one entry may go on: it is kept for the next batch
            shared = sizes[at:] > 1
            run_starts, run_sizes = starts[at:][shared], sizes[at:][shared]
            if len(run_starts):
                lead = np.repeat(run_starts, run_sizes)
                within = np.arange(len(lead)) - np.repeat(np.cumsum(run_sizes) - run_sizes, run_sizes)
                where = lead + within
                yield out(_RUN, [r[where] for r in rows], [r[lead] for r in rows])
        first = tuple(r[starts[-1]] for r in rows)
        seen = int(sizes[-1])
    if first is not None:
        own = single(first, rows)
        if started and seen == 1:
            yield out(_OPEN, own, own)
        yield out(_EDGE, own, own, seen)


def shared_entries(prefixes: DataFrame) -> DataFrame:
    """node, n, place and pivot, pivot_n, pivot_place for every prefix n-gram of two sets or more."""
    entries = prefixes.select("node", "n", "rare", F.posexplode("prefix").alias("place", "ngram")).select(*_ENTRY)
    ranged = entries.repartitionByRange(shuffle_partitions(prefixes.sparkSession), "ngram", "rare", "node")
    found = materialize(ranged.sortWithinPartitions("ngram", "rare", "node").mapInArrow(_runs, _RUNS))
    # two rows a task at most
    edges = found.where(F.col("kind") == _EDGE).groupBy("ngram").agg(
        F.sum("entries").alias("_entries"), F.min(F.struct("rare", "node", "n", "place")).alias("_first")).where("_entries > 1")
    names = ["node", "n", "place"]
    closed = found.where(F.col("kind") == _RUN).select(*names, "pivot", "pivot_n", "pivot_place")
    still_open = found.where(F.col("kind") == _OPEN).join(edges, "ngram").select(
        *names, F.col("_first.node").alias("pivot"), F.col("_first.n").alias("pivot_n"), F.col("_first.place").alias("pivot_place"))
    return closed.unionByName(still_open)


# ---- pairs ----


def _bounded(rule: Rule, place_a: Column, na: Column, place_b: Column, nb: Column) -> Column:
    """Whether a pair whose first common n-gram has these places can reach the threshold."""
    return rule.reachable(F.least(na - place_a, nb - place_b), na, nb)


def _by_prefix(pairs: DataFrame, prefixes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) that the common part of their prefixes does not rule out."""
    left = prefixes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    right = prefixes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    common = F.size(F.array_intersect("pa", "pb"))
    end_a, end_b = F.element_at("pa", -1), F.element_at("pb", -1)
    rest_a, rest_b = F.col("na") - F.size("pa"), F.col("nb") - F.size("pb")
    # n-grams behind the prefix that ends first
    behind = F.when(end_a <= end_b, rest_a).otherwise(rest_b)
    return pairs.join(left, "a").join(right, "b").where(
        rule.reachable(common + behind, F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")


def _segments(documents: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """(node, segments): the sets of ``members`` (node, doc_id), their global order cut by hash into ``FRAGMENTS`` arrays."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap_of(members))
    edges = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 63) // FRAGMENTS)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, 0):
            sets = [h for h in ngram_hashes(texts.filter(_chosen(shared.value, part)), rule.size) if len(h)]
            bounds = [np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]) for h in sets]
            lengths = np.concatenate([np.diff(b) for b in bounds]) if sets else np.empty(0, dtype=np.int64)
            values = np.concatenate(sets).astype(np.int64) if sets else np.empty(0, dtype=np.int64)
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(lengths) + 1, FRAGMENTS, dtype=np.int32)), inner)
            yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in sets], pa.int64()), outer], names=["node", "segments"])

    cut_rows = documents.mapInArrow(cut, "node long, segments array<array<long>>")
    return cut_rows.join(members.select("node"), "node")


def verified(pairs: DataFrame, segments: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, na, nb) that are links, by overlaps per fragment, summed."""
    by_fragment = segments.select("node", F.posexplode("segments").alias("fragment", "ngrams"))
    left = by_fragment.select(F.col("node").alias("a"), "fragment", F.col("ngrams").alias("sa"))
    right = by_fragment.select(F.col("node").alias("b"), "fragment", F.col("ngrams").alias("sb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "na", "nb", "fragment", F.size(F.array_intersect("sa", "sb")).cast("long").alias("overlap"))
    # repeated rows of a document give equal segments
    once = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("overlap").alias("overlap"))
    summed = once.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return summed.where(rule.reachable(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def _near(rule: Rule) -> Column:
    """Whether members _a and _b of a group can be linked and are not yet joined."""
    reach = F.least("reach_a", "reach_b")
    return (F.col("comp_a") != F.col("comp_b")) & rule.reachable(reach, F.col("n_a"), F.col("n_b"))


def _side(members: DataFrame, name: str) -> DataFrame:
    return members.select("pivot", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "reach", "comp", "outside")])


def _small_pairs(members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of groups of at most ``SMALL`` members, of which one at least is outside its pivot's component."""
    first, second = _side(members.where("outside"), "a"), _side(members, "b")
    both = first.join(second, "pivot").where(
        _near(rule) & (~F.col("outside_b") | (F.col("node_a") < F.col("node_b"))) & (F.col("node_b") != F.col("pivot")))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _block_links(rule: Rule):
    percent = rule.percent

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks of a group, as many as join its components: a forest, never all pairs."""
        sides = []
        for side in (0, 1):
            head = rows[rows["side"] == side].drop_duplicates("node")
            sides.append((head["node"].to_numpy(), head["n"].to_numpy(dtype=np.int64), head["comp"].to_numpy(), list(head["segments"])))
        (node_a, n_a, comp_a, cut_a), (node_b, n_b, comp_b, cut_b) = sides
        overlap = np.zeros((len(node_a), len(node_b)), dtype=np.float32)
        for fragment in range(FRAGMENTS):
            cells = []
            for cuts in (cut_a, cut_b):
                values = [c[fragment] for c in cuts]
                row = np.repeat(np.arange(len(values)), [len(v) for v in values])
                cells.append((row, np.concatenate(values) if values else np.empty(0, dtype=np.int64)))
            common = np.intersect1d(cells[0][1], cells[1][1])
            for at in range(0, len(common), 4096):
                names = common[at : at + 4096]
                dense = []
                for (row, value), nodes in zip(cells, (node_a, node_b), strict=True):
                    column = np.minimum(np.searchsorted(names, value), len(names) - 1)
                    hit = names[column] == value
                    matrix = np.zeros((len(nodes), len(names)), dtype=np.float32)
                    matrix[row[hit], column[hit]] = 1
                    dense.append(matrix)
                overlap += dense[0] @ dense[1].T
        linked = (100 + percent) * overlap.astype(np.int64) >= percent * (n_a[:, None] + n_b[None, :])
        linked &= comp_a[:, None] != comp_b[None, :]
        above: dict[int, int] = {}

        def find(c: int) -> int:
            while above.setdefault(c, c) != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(int(comp_a[i])), find(int(comp_b[j]))
            if a != b:
                above[b] = a
                out.append((int(node_a[i]), int(node_b[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    return links


def _large_links(members: DataFrame, segments: DataFrame, rule: Rule) -> DataFrame:
    """Links of groups of more than ``SMALL`` members: members outside their pivot's component against all, in blocks."""
    first = members.where("outside").withColumn("bo", F.pmod(F.xxhash64("node"), F.ceil(F.col("out") / BLOCK)))
    first = first.withColumn("ba", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK) - 1))).withColumn("side", F.lit(0))
    second = members.withColumn("ba", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
    second = second.withColumn("bo", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("out") / BLOCK) - 1))).withColumn("side", F.lit(1))
    names = ["pivot", "bo", "ba", "side", "node", "n", "comp"]
    sent = first.select(*names).unionByName(second.select(*names)).join(segments, "node")
    return sent.groupBy("pivot", "bo", "ba").applyInPandas(_block_links(rule), "a long, b long")


def classes_and_links(documents: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets: doc_id, n, node), (classes: node, doc_id), (links a, b that connect all components)."""
    spark = documents.sparkSession
    ship(spark)
    whole = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    bits = 32 + (4 * shuffle_partitions(spark)).bit_length()
    surveyed = materialize(survey(whole, rule, bits))
    sets = surveyed.where("n IS NOT NULL").select("doc_id", "n", "node")
    classes = materialize(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    frequent = frequent_prints(surveyed.where("bucket IS NOT NULL").select("bucket", "prints", "times"), rule)
    marked = whole.withColumn("_bit", _bit(F.col("doc_id")))
    prefixes = materialize(prefixes_of(marked, classes, rule, frequent, bits), **PLAIN)
    bounded = _bounded(rule, F.col("place"), F.col("n"), F.col("pivot_place"), F.col("pivot_n"))
    members = materialize(shared_entries(prefixes).groupBy("pivot", "node", "n").agg(
        F.max(bounded).alias("bounded"), F.max(F.col("n") - F.col("place")).alias("reach")))

    def segments_of(nodes: DataFrame) -> DataFrame:
        return materialize(_segments(marked, materialize(classes.join(nodes.distinct(), "node", "left_semi")), rule), **PLAIN)

    to_pivot = members.where((F.col("node") != F.col("pivot")) & F.col("bounded")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    pairs = materialize(_by_prefix(to_pivot, prefixes, rule))
    links = materialize(verified(pairs, segments_of(_ends(pairs)), rule))
    names = components(links)

    found = members.drop("bounded").join(names.select("node", "label"), "node", "left").join(
        names.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot", "left")
    own, lead = F.coalesce("label", "node"), F.coalesce("pivot_label", "pivot")
    placed = found.select("pivot", "node", "n", "reach", own.alias("comp"), (own != lead).alias("outside"))
    # a pair apart from the pivot needs a third member
    sizes = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("outside"), F.lit(1))).alias("out")).where("out > 0 AND size > 2")
    left = materialize(placed.join(sizes, "pivot"))
    small = materialize(_by_prefix(_small_pairs(left.where(F.col("size") <= SMALL), rule), prefixes, rule))
    large = left.where(F.col("size") > SMALL)
    nodes = _ends(small).union(large.select("node"))
    if not nodes.isEmpty():
        segments = segments_of(nodes)
        links = links.union(materialize(verified(small, segments, rule).union(_large_links(large, segments, rule))))
    return sets, classes, links


def component_ids(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    sets, classes, links = classes_and_links(documents, rule or Rule())
    labels = components(links)
    named = materialize(classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = materialize(named.join(smallest, "label").select("node", "component_id"))
    return sets.join(component, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row of each component, in all its columns: of its smallest id, null the largest; of repeated rows one stays.

    Rows are told apart by id and text, so each text under a null or repeated id counts. Documents without a word all stay.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    ids = component_ids(documents.select(key.alias("doc_id"), "text"), rule).select(
        F.col("doc_id").alias("_key"), (F.col("n_shingles") > 0).alias("_worded"), "component_id")
    own = documents.select(key.alias("_key"), F.col("doc_id").alias("_id")).dropDuplicates(["_key"])
    least = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_key")))
    kept = ids.join(own, "_key").groupBy("component_id", "_worded").agg(least.alias("_least")).select(F.col("_least._key").alias("_key"), "_worded")
    met = documents.select(key.alias("_key"), F.struct(*documents.columns).alias("row")).join(kept, "_key")
    order = Window.partitionBy("_key", "_worded").orderBy(F.xxhash64("row"))
    return met.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) | ~F.col("_worded")).select("row.*")
