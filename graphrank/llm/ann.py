"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their id, so copies of one vector
spread over all shards. A shard's graph is built by searching it for each new vector, a batch at a time, and linking
the vector with diverse near ones; nodes are inserted from the highest level down. Graphs are stored as rows:
a node has its vector, the ids of all equal vectors of the shard, its level, and one flat array of links, the
32 of level 0 first, then 16 for each higher level, -1 where there is none. Queries are sent to
every shard, searched in blocks, and the shards' nearest are merged.

Cases: a null id, a null or empty vector, one of zeros only or with a null or non-finite component takes no
part; vectors of different length are never compared; of repeated ids the smallest vector counts;
equal distances go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphrank.llm.common import materialize, ship

#: Links of a node at level 0 and above, beams of building and searching, rows of a block.
LINKS, UPPER, BUILD_BEAM, SEARCH_BEAM, BLOCK = 32, 16, 96, 256, 256
SHARD_ROWS = 4096
_INDEX = "shard string, kind int, position int, ids array<long>, vector array<double>, level int, links array<int>"


def taking_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


# ---- a graph in arrays ----

#: Largest component of a moved vector, and mean square of components from which a query is far from the shard.
_OUTSIDE, _FAR = 1e12, 1e3


def _power(values: np.ndarray) -> float:
    """A power of two by which the largest component becomes about 1: multiplying by it is exact."""
    most = float(np.abs(values).max(initial=0.0))
    return math.ldexp(1.0, max(-1000, min(1000, -math.frexp(most)[1]))) if most else 1.0



class Graph:
    """Vectors (n, d), levels (n,), links[level] (n, width) with -1 for none.

    The graph works in single precision on vectors that are moved to their median and scaled, so that neither a common
    offset nor the size of the numbers costs precision; scores are computed from the original vectors.
    """

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.scale = [_power(vectors)]
        self.centre = np.median(vectors * self.scale[0], axis=0) if len(vectors) else 0.0  # a few far vectors do not move it
        self.scale.append(_power(vectors * self.scale[0] - self.centre))
        self.x = self.moved(vectors)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.levels = levels
        top = int(levels.max()) if len(levels) else 0
        self.links = [np.full((len(vectors), LINKS if k == 0 else UPPER), -1, dtype=np.int32) for k in range(top + 1)]
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    def moved(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as the graph sees them; those very far outside come as near as single precision needs."""
        with np.errstate(over="ignore"):
            return np.clip((vectors * self.scale[0] - self.centre) * self.scale[1], -_OUTSIDE, _OUTSIDE).astype(np.float32)

    def distances(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances (b, m) of queries (b, d) from nodes (b, m); of far queries less a constant that would swallow the differences."""
        product = np.matmul(self.x[nodes], query[:, :, None])[:, :, 0]
        own = np.einsum("ij,ij->i", query, query)
        far = own > _FAR * query.shape[1]
        return np.maximum(self.norm[nodes] - 2 * product + np.where(far, 0, own)[:, None], np.where(far, -np.inf, 0)[:, None])

    def search(self, query: np.ndarray, entry: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query as (nodes, distances), nearest first; -1 and inf fill it up. All queries step together."""
        b = len(query)
        links = self.links[level]
        seen = np.zeros((b, len(self.x) + 1), dtype=bool)  # the last column takes the fills
        rows = np.arange(b)
        nodes = np.full((b, beam), -1, dtype=np.int32)
        far = np.full((b, beam), np.inf, dtype=np.float32)
        done = np.ones((b, beam), dtype=bool)
        nodes[:, 0], done[:, 0] = entry, False
        far[:, 0] = self.distances(query, entry[:, None])[:, 0]
        seen[rows, entry] = True
        active = rows
        while len(active):
            open_far = np.where(done[active], np.inf, far[active])
            best = open_far.argmin(axis=1)
            going = np.isfinite(open_far[np.arange(len(active)), best])
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            near = links[nodes[active, best]]
            new = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], np.where(new, near, -1)] = True
            got = np.where(new, self.distances(query[active], np.maximum(near, 0)), np.inf)
            all_far = np.concatenate([far[active], got], axis=1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam] if beam > 1 else all_far.argmin(axis=1)[:, None]
            take = np.take_along_axis
            far[active] = take(all_far, keep, 1)
            nodes[active] = take(np.concatenate([nodes[active], np.where(new, near, -1)], axis=1), keep, 1)
            done[active] = take(np.concatenate([done[active], ~new], axis=1), keep, 1)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)

    def descend(self, query: np.ndarray, level: int) -> np.ndarray:
        """Nearest node found of each query from the entry down to just above ``level``."""
        entry = np.full(len(query), self.entry, dtype=np.int32)
        for k in range(len(self.links) - 1, level, -1):
            entry = self.search(query, entry, k, 1)[0][:, 0]
        return entry

    def diverse(self, nodes: np.ndarray, far: np.ndarray, width: int) -> np.ndarray:
        """Of candidates (b, c), nearest first, those nearer to the base than to any taken before; then the nearest others."""
        b, c = nodes.shape
        vectors = self.x[np.maximum(nodes, 0)]
        norm = self.norm[np.maximum(nodes, 0)]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        real = (nodes >= 0) & np.isfinite(far)
        nearest_taken = np.full((b, c), np.inf, dtype=np.float32)
        taken = np.zeros((b, c), dtype=bool)
        count = np.zeros(b, dtype=np.int64)
        for j in range(c):
            ok = real[:, j] & (far[:, j] < nearest_taken[:, j]) & (count < width)
            taken[:, j] = ok
            count += ok
            nearest_taken = np.where(ok[:, None], np.minimum(nearest_taken, between[:, j]), nearest_taken)
        rank = np.where(taken, 0, np.where(real, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :width]
        return np.where(np.take_along_axis(real, order, 1), np.take_along_axis(nodes, order, 1), -1)

    def link_back(self, base: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Add the reverse of the links base -> chosen; a full list keeps diverse ones."""
        links = self.links[level]
        width = links.shape[1]
        target, source = chosen.ravel(), np.repeat(base, chosen.shape[1])
        source, target = source[target >= 0], target[target >= 0]
        while len(target):
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            starts = np.flatnonzero(np.diff(target, prepend=-1))
            place = np.arange(len(target)) - np.repeat(starts, np.diff(np.append(starts, len(target))))
            now = place < width  # at most as many at a time as a list has
            nodes = target[starts]
            new = np.full((len(nodes), width), -1, dtype=np.int32)
            new[np.searchsorted(nodes, target[now]), place[now]] = source[now]
            every = np.concatenate([links[nodes], new], axis=1)
            every = np.where((every[:, :, None] == every[:, None, :]).argmax(axis=2) == np.arange(every.shape[1]), every, -1)
            far = np.where(every >= 0, self.distances(self.x[nodes], np.maximum(every, 0)), np.inf)
            order = np.argsort(far, axis=1, kind="stable")
            every, far = np.take_along_axis(every, order, 1), np.take_along_axis(far, order, 1)
            few = (every >= 0).sum(axis=1) <= width
            links[nodes[few]] = every[few, :width]
            for at in range(0, (~few).sum(), BLOCK):
                some = np.flatnonzero(~few)[at : at + BLOCK]
                links[nodes[some]] = self.diverse(every[some], far[some], width)
            source, target = source[~now], target[~now]

    def build(self) -> Graph:
        order = np.argsort(-self.levels, kind="stable")
        at = 1
        while at < len(order):
            batch = order[at : at + min(BLOCK, max(1, at // 2))]
            query = self.x[batch]
            entry = np.full(len(batch), self.entry, dtype=np.int32)
            among = self.norm[batch][:, None] + self.norm[batch] - 2 * query @ query.T
            np.fill_diagonal(among, np.inf)
            for k in range(len(self.links) - 1, -1, -1):
                here = self.levels[batch] >= k
                if not here.all():
                    entry[~here] = self.search(query[~here], entry[~here], k, 1)[0][:, 0]
                if here.any():
                    base = batch[here]
                    nodes, far = self.search(query[here], entry[here], k, BUILD_BEAM)
                    entry[here] = nodes[:, 0]
                    # vectors of the same batch do not see each other in the graph
                    peers = np.where(here[None, :], among[here], np.inf)
                    some = np.argsort(peers, axis=1)[:, :LINKS]
                    far = np.concatenate([far, np.take_along_axis(peers, some, 1)], axis=1)
                    nodes = np.where(np.isfinite(far), np.concatenate([nodes, batch[some]], axis=1), -1)
                    sort = np.argsort(far, axis=1, kind="stable")
                    chosen = self.diverse(np.take_along_axis(nodes, sort, 1), np.take_along_axis(far, sort, 1), self.links[k].shape[1])
                    self.links[k][base] = chosen
                    self.link_back(base, chosen, k)
            at += len(batch)
        return self

    def flat(self) -> list[np.ndarray]:
        return [np.concatenate([self.links[k][i] for k in range(self.levels[i] + 1)]) for i in range(len(self.levels))]

    @staticmethod
    def from_flat(vectors: np.ndarray, levels: np.ndarray, flat: list[np.ndarray]) -> Graph:
        graph = Graph(vectors, levels)
        for i, row in enumerate(flat):
            graph.links[0][i] = row[:LINKS]
            for k in range(1, levels[i] + 1):
                graph.links[k][i] = row[LINKS + (k - 1) * UPPER : LINKS + k * UPPER]
        return graph


def _levels(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the id: equal in every run."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    share = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(share) / math.log(UPPER)).astype(np.int64)


# ---- index and search in Spark ----


def _sharded(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``shard``, shards per length of vector). A shard is named by the length and a number."""
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    lengths = materialize(lengths)
    number = F.pmod(F.xxhash64("id"), F.col("shards"))
    return rows.join(lengths, F.size("vector") == F.col("length")).select("id", "vector", F.concat_ws(":", "length", number).alias("shard")), lengths


def vectors_of(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, vector in double precision, of the rows that take part."""
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & taking_part(F.col("vector")))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of each shard's graph: shard, kind (0), position, ids, vector, level, links."""
    ship(rows.sparkSession)
    sharded, _ = _sharded(rows, shard_rows)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(group["vector"].tolist(), dtype=np.float64)
        ids = group["id"].to_numpy(dtype=np.int64)
        order = np.lexsort((*matrix.T[::-1], ids))
        first = order[np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1))]  # of an id the smallest vector
        matrix, ids = matrix[first], ids[first]
        distinct, node = np.unique(matrix, axis=0, return_inverse=True)
        sort = np.lexsort((ids, node.ravel()))
        members = np.split(ids[sort], np.flatnonzero(np.diff(node.ravel()[sort])) + 1)
        graph = Graph(distinct, _levels(np.array([m[0] for m in members]))).build()
        return pd.DataFrame({
            "shard": group["shard"].iloc[0], "kind": 0, "position": np.arange(len(distinct)), "ids": members, "vector": list(distinct),
            "level": graph.levels, "links": graph.flat()})

    # explicit partitions: a shard is much work and few bytes
    parts = 4 * (sharded.select("shard").distinct().count() or 1)
    return sharded.repartition(parts, "shard").groupBy("shard").applyInPandas(build, _INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (id, vector), itself left out."""
    ship(index.sparkSession)
    shards = index.select("shard").distinct().select("shard", F.split("shard", ":")[0].cast("int").alias("length"))
    listed = materialize(shards)
    one = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    sent = one.join(listed, F.size("vector") == F.col("length")).select(
        "shard", F.lit(1).alias("kind"), F.lit(0).alias("position"), F.array("id").alias("ids"), "vector",
        F.lit(0).alias("level"), F.array().cast("array<int>").alias("links"))

    def nearest(graph: Graph, exact: np.ndarray, members: list[np.ndarray], block: list[tuple]) -> pd.DataFrame:
        query = np.array([b[1] for b in block], dtype=np.float64)
        small = graph.moved(query)
        nodes, _ = graph.search(small, graph.descend(small, 0), 0, min(max(beam, k + 1), len(exact)))
        out = []
        for (own, _), vector, row in zip(block, query, nodes, strict=True):
            row = row[row >= 0]
            score = np.sqrt(((exact[row] - vector) ** 2).sum(axis=1))
            ids = [members[i][: k + 1] for i in row]
            flat, scores = np.concatenate(ids), np.repeat(score, [len(i) for i in ids])
            keep = flat != own
            flat, scores = flat[keep], scores[keep]
            best = np.lexsort((flat, scores))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": flat[best], "score": scores[best]}))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by shard: the nodes of a graph, then the queries, which are answered block by block."""
        shard, rows, graph, exact, members, block = None, [], None, None, [], []
        for batch in batches:
            for name, kind, ids, vector, level, links in zip(*[batch[c] for c in ("shard", "kind", "ids", "vector", "level", "links")], strict=True):
                if name != shard:
                    if block:
                        yield nearest(graph, exact, members, block)
                    shard, rows, graph, block = name, [], None, []
                if kind == 0:
                    rows.append((ids, vector, level, links))
                    continue
                if graph is None:
                    if not rows:
                        continue
                    exact, members = np.array([r[1] for r in rows], dtype=np.float64), [r[0] for r in rows]
                    graph = Graph.from_flat(exact, np.array([r[2] for r in rows], dtype=np.int64), [r[3] for r in rows])
                    rows = []
                block.append((int(ids[0]), vector))
                if len(block) == BLOCK:
                    yield nearest(graph, exact, members, block)
                    block = []
        if block:
            yield nearest(graph, exact, members, block)

    parts = 4 * (listed.count() or 1)
    placed = index.unionByName(sent).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "position")
    found = placed.mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
