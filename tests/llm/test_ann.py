import numpy as np
from pyspark.sql import functions as F

from graphrank.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def nearest(rows, query, k):
    """Brute force over all rows that take part; of repeated ids the smallest vector."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    q = np.array(good[query], dtype=np.float32).astype(float)
    found = sorted((float(np.sqrt(((np.array(v, dtype=np.float32).astype(float) - q) ** 2).sum())), i)
                   for i, v in good.items() if i != query and len(v) == len(q))
    return found[:k]


def test_recall_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in draw.normal(size=8)]) for i in range(1, 1200)]
    rows += [(2000 + i, rows[99][1]) for i in range(40)]  # copies of the vector of id 100
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [float("inf")] + [1.0] * 7),
             (None, [1.0] * 8), (3005, [1.0, 2.0]), (3100, [1.0, 2.5]), (7, rows[6][1])]
    vectors = ann.vectors_of(table(spark, rows))
    index = ann.build_index(vectors, shard_rows=300)
    got = ann.search(index, vectors.where(F.col("id") % 100 == 0), k=10).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    assert {3001, 3002, 3003, 3004}.isdisjoint({r["vec_id"] for r in got})
    hits = total = 0
    for query, found in by_query.items():
        found.sort(key=lambda r: r["rank"])
        want = nearest(rows, query, 10)
        assert [r["rank"] for r in found] == list(range(1, len(want) + 1))
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        hits += len({i for _, i in want} & {r["vec_id"] for r in found})
        total += len(want)
        for r in found:
            assert abs(r["score"] - dict((i, s) for s, i in nearest(rows, query, 10**6))[r["vec_id"]]) < 1e-12
    assert hits >= 0.95 * total
    assert [r["vec_id"] for r in sorted(by_query[100], key=lambda r: r["rank"])] == list(range(2000, 2010))
    assert [r["vec_id"] for r in by_query[3100]] == [3005]


def test_empty_table(spark):
    vectors = ann.vectors_of(table(spark, []))
    assert ann.search(ann.build_index(vectors), vectors).count() == 0


def test_flat_round_trip():
    x = np.random.default_rng(2).normal(size=(400, 6))
    graph = ann.Graph(x, ann._levels(np.arange(400))).build()
    again = ann.Graph.from_flat(x, graph.levels, graph.flat())
    for a, b in zip(graph.links, again.links, strict=True):
        assert (a == b).all()


def _recall(x, query, k=10):
    graph = ann.Graph(x, ann._levels(np.arange(len(x)))).build()
    moved = graph.moved(query)
    nodes, _ = graph.search(moved, graph.descend(moved, 0), 0, ann.SEARCH_BEAM)
    hits = 0
    for row, q in zip(nodes, query):
        row = row[row >= 0]
        found = row[np.argsort(((x[row] - q) ** 2).sum(axis=1))[:k]]
        hits += len(set(found) & set(np.argsort(((x - q) ** 2).sum(axis=1))[:k]))
    return hits / (k * len(query))


def test_offset_and_size_cost_no_recall():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 32))
    tables = {"plain": x, "offset": x + 1e4, "far offset": x - 1e9, "large": x * 1e25, "very large": x * 1e150, "small": x * 1e-30,
              "some far": np.concatenate([x, x[:3] * 1e6]), "one": x[:1], "equal": np.ones((5, 4))}
    for name, rows in tables.items():
        assert _recall(rows, rows[:60], min(10, len(rows))) >= 0.95, name
    for query in (draw.normal(size=(40, 32)) * 1e5, x[:40] + 1e7, draw.normal(size=(40, 32)) * 1e11):  # far from all vectors
        assert _recall(x, query) >= 0.95
