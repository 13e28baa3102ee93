"""Queries over scorers, metrics and ablation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrank.catalog.columns import scratch
from graphrank.catalog.graphs import pagerank_sql
from graphrank.catalog.links import links_of
from graphrank.catalog.registry import query
from graphrank.catalog.sql import gene, hexnum, with_tables
from graphrank.functions import vectors as V
from graphrank.operators import ablation as A
from graphrank.operators import evaluate as E
from graphrank.operators import scorers as R
from graphrank.operators import splits as S
from graphrank.operators.ordering import hash_number, stable_hash
from graphrank.plans.binding import Sources, gene_key
from graphrank.plans.lineage import materialize
from graphrank.plans.pipeline import triples
from graphrank.sources import tables as T

SEEDS = E.DEFAULT_SEEDS
_SEED_ROWS = "(VALUES (13), (17), (19), (23), (29)) sd(seed)"


def disease_triples(s: Sources) -> DataFrame:
    return triples(s.edges("disease_gene"))


def disease_parts(s: Sources) -> DataFrame:
    """Parts of the associated_with links, with a label column."""
    parts = S.partition_links(links_of(s, "disease_gene"), S.SplitOptions(relations=("associated_with",)))
    return materialize(parts.withColumn("label", F.lit(1)))


def as_triples(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("head"), F.col("edge_type").alias("relation"), F.col("dst").alias("tail"))


# a number in [0, 1) from a hash: scores without ties that both engines compute alike
def hash_score(*parts: Column | str) -> Column:
    return (hash_number(stable_hash(*parts), 1, 8) / float(16**8)).alias("score")


def _hash_sql(parts: str) -> str:
    return f"{hexnum(f'md5({parts})', 1, 8)} / CAST(4294967296 AS DOUBLE)"


# --------------------------------------------------------------------------- scorers


@query("B1", with_tables("pop", "SELECT tail, score FROM pop"))
def popularity_scores(s: Sources) -> DataFrame:
    return R.popularity(disease_triples(s))


@query("B2", with_tables("dg", "SELECT node AS tail, round(r + d, 9) AS score FROM pr JOIN deg ON a = node WHERE it = 50",
                         pagerank_sql("SELECT head, tail FROM dg", 50), recursive=True))
def centrality_scores(s: Sources) -> DataFrame:
    return R.centrality(disease_triples(s)).withColumn("score", F.round("score", 9))




def _hashed_sql(name: str, table: str, key: str, dim: int = 64) -> str:
    blanks = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"""{name}_w AS (SELECT {key} AS id, sha256(unnest(list_filter(regexp_split_to_array(replace(lower(text), '_', ' '), '{blanks}'), lambda x: x <> ''))) AS d FROM {table}),
    {name} AS MATERIALIZED (SELECT id, CAST(CAST('0x' || substr(d, 1, 16) AS UBIGINT) % {dim} AS BIGINT) AS idx,
        sum(CASE WHEN CAST('0x' || substr(d, 17, 2) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END) AS v FROM {name}_w GROUP BY 1, 2)"""


@query("B6, C10, C12", f"""WITH {_hashed_sql('d', 'documents', 'doc_id')}, {_hashed_sql('b', 'benchmark', 'item_id')},
    dl AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS n FROM d GROUP BY 1), bl AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS n FROM b GROUP BY 1),
    p AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents)
    SELECT CAST(p.doc_id AS VARCHAR) AS head, CAST(p.item_id AS VARCHAR) AS tail, round(coalesce(CAST(x.s AS DOUBLE) / (dl.n * bl.n), 0.0), 6) AS score FROM p
    JOIN dl ON dl.id = p.doc_id JOIN bl ON bl.id = p.item_id
    LEFT JOIN (SELECT p.doc_id, sum(d.v * b.v) AS s FROM p JOIN d ON d.id = p.doc_id JOIN b ON b.id = p.item_id AND b.idx = d.idx GROUP BY 1) x ON x.doc_id = p.doc_id""")
def text_scores(s: Sources) -> DataFrame:
    """Documents against one benchmark text each, by cosine of hashed word vectors."""
    texts = s.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("node"), "text").unionByName(
        s.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("node"), "text")
    )
    items = s.table("benchmark").agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = s.table("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("head"), F.concat(F.lit("b"), F.col("doc_id") % items).alias("tail")
    )
    vectors = V.hashed_vectors(texts, "node", F.col("text"), 64)
    return R.cosine_scores(pairs, vectors, 64).select(
        F.substring("head", 2, 20).alias("head"), F.substring("tail", 2, 20).alias("tail"), F.round("score", 6).alias("score")
    )


# heads, tails and relations with the test table's vectors: links vec_id -> next vec_id, relation by label
def _vector_links(s: Sources) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = s.table("embeddings").select(
        F.col("vec_id").cast("string").alias("node"), F.col("embedding").cast("array<double>").alias("vector"), "label", "vec_id"
    )
    links = rows.select(F.col("node").alias("head"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("relation"),
                        (F.col("vec_id") + 1).cast("string").alias("tail"))
    weights = rows.groupBy(F.concat(F.lit("r"), F.col("label").cast("string")).alias("relation")).agg(
        F.array(*[F.avg(F.col("vector")[i]) for i in range(64)]).alias("weight")
    )
    return links, rows.select("node", "vector"), weights


_VEC = """v AS MATERIALIZED (SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    w AS MATERIALIZED (SELECT label, i, avg(x) AS x FROM v GROUP BY 1, 2),
    j AS MATERIALIZED (SELECT h.vec_id, h.label, h.x AS hx, w.x AS rx, t.x AS tx FROM v h JOIN w ON w.label = h.label AND w.i = h.i LEFT JOIN v t ON t.vec_id = h.vec_id + 1 AND t.i = h.i)"""


def _model_sql(model: str, formula: str) -> str:
    return f"""SELECT '{model}' AS model, CAST(vec_id AS VARCHAR) AS head, 'r' || label AS relation, CAST(vec_id + 1 AS VARCHAR) AS tail,
        round(coalesce({formula}, 0.0), 6) AS score FROM j GROUP BY vec_id, label"""


@query("B7", f"""WITH {_VEC} {_model_sql('TransE', '-sqrt(sum((hx + rx - tx) * (hx + rx - tx)))')}
    UNION ALL {_model_sql('RotatE', '-sqrt(sum((hx + rx - tx) * (hx + rx - tx)))')}
    UNION ALL {_model_sql('DistMult', 'sum(hx * rx * tx)')} UNION ALL {_model_sql('ComplEx', 'sum(hx * rx * tx) + sum(hx * tx)')}""")
def kge_scores(s: Sources) -> DataFrame:
    links, vectors, weights = _vector_links(s)
    out = None
    for model in R.KGE_MODELS:
        scored = R.kge_scores(links, vectors, weights, model).select(
            F.lit(model).alias("model"), "head", "relation", "tail", F.round("score", 6).alias("score")
        )
        out = scored if out is None else out.unionByName(scored)
    return out


@query("B10, B13", f"""WITH {_VEC} {_model_sql('dot', 'sum(hx * tx)')} UNION ALL {_model_sql('distmult', 'sum(hx * rx * tx)')}""")
def decoder_scores(s: Sources) -> DataFrame:
    links, vectors, weights = _vector_links(s)
    dot = R.decode(links, vectors, "dot").withColumn("model", F.lit("dot"))
    return dot.unionByName(R.decode(links, vectors, "distmult", weights).withColumn("model", F.lit("distmult"))).select(
        "model", "head", "relation", "tail", F.round("score", 6).alias("score")
    )


@query("B12, N5", with_tables("links", f"""SELECT edge_type, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS loss, count(*) AS links FROM s GROUP BY 1""",
    f"""s AS (SELECT edge_type, 4 * ({_hash_sql("concat_ws('|', src, dst)")}) - 2 AS x, CAST({_hash_sql("concat_ws('|', dst, src)")} < 0.5 AS INTEGER) AS y FROM links)"""))
def relation_losses(s: Sources) -> DataFrame:
    links = links_of(s)
    scored = links.select("edge_type", (4.0 * hash_score(F.col("src"), F.col("dst")) - 2.0).alias("score"),
                          (hash_score(F.col("dst"), F.col("src")) < 0.5).cast("int").alias("label"))
    return R.relation_losses(scored).withColumn("loss", F.round("loss", 6))


@query("B12", with_tables("links", """SELECT round(avg(loss), 6) AS loss FROM (SELECT avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) AS loss FROM s GROUP BY edge_type)""",
    f"""s AS (SELECT edge_type, 4 * ({_hash_sql("concat_ws('|', src, dst)")}) - 2 AS x, CAST({_hash_sql("concat_ws('|', dst, src)")} < 0.5 AS INTEGER) AS y FROM links)"""))
def multitask_loss(s: Sources) -> DataFrame:
    links = links_of(s)
    scored = links.select("edge_type", (4.0 * hash_score(F.col("src"), F.col("dst")) - 2.0).alias("score"),
                          (hash_score(F.col("dst"), F.col("src")) < 0.5).cast("int").alias("label"))
    return R.multitask_loss(scored).withColumn("loss", F.round("loss", 6))


def labelled_links(s: Sources) -> DataFrame:
    """Split of the associated_with links with one negative per positive."""
    options = S.SplitOptions(relations=("associated_with",), eval_negatives=1.0)
    return materialize(S.split_links(links_of(s, "disease_gene"), options))


def _examples(links: DataFrame, split: str) -> DataFrame:
    rows = S.supervision_links(links, split)
    return rows.select(F.col("src").alias("head"), F.col("edge_type").alias("relation"), F.col("dst").alias("tail"), "label")


def node_numbers(s: Sources) -> DataFrame:
    """Two scaled numbers per customer and part: ``(node_type, node_id, x)``."""
    customers = s.table("customer").select(F.lit("disease").alias("node_type"), F.concat(F.lit("C"), "c_custkey").alias("node_id"),
                                           F.array(F.col("c_acctbal") / 10000.0, F.col("c_nationkey") / 25.0).alias("x"))
    parts = s.table("part").select(F.lit("gene"), gene_key(F.col("p_partkey")),
                                   F.array(F.col("p_retailprice") / 2000.0, F.col("p_size") / 50.0))
    return customers.union(parts)


@query("B4")
def factor_scores(s: Sources) -> DataFrame:
    links = labelled_links(s)
    heads, tails = R.fit_factors(as_triples(S.message_links(links)))
    return R.factor_scores(_examples(links, "test"), heads, tails)


@query("B5")
def structure_scores(s: Sources) -> DataFrame:
    links = labelled_links(s)
    scorer = R.structure_scores(as_triples(S.message_links(links)))
    return scorer(_examples(links, "test"))


@query("B8")
def fitted_kge_scores(s: Sources) -> DataFrame:
    links = labelled_links(s)
    fit = R.fit_kge(_examples(links, "train"), learning_rate=0.5)
    return R.kge_scores(_examples(links, "test"), fit.entities, fit.relations, "DistMult")


@query("B8, E15")
def early_stopped_kge(s: Sources) -> DataFrame:
    """The loop keeps the epoch whose validation score is best."""
    links = labelled_links(s)
    held_out = _examples(links, "val")

    def validate(entities: DataFrame, relations: DataFrame) -> float:
        return E.auprc(R.kge_scores(held_out, entities, relations, "DistMult")).first()["auprc"]

    fit = R.fit_kge(_examples(links, "train"), learning_rate=0.5, validate=validate)
    rows = _examples(links, "test")
    return R.kge_scores(rows, fit.entities, fit.relations, "DistMult").withColumn("best_epoch", F.lit(fit.best_epoch))


@query("B11")
def perceptron_scores(s: Sources) -> DataFrame:
    links = labelled_links(s)
    vectors = node_numbers(s).select(F.col("node_id").alias("node"), F.col("x").alias("vector"))
    model = R.fit_perceptron(_examples(links, "train"), vectors, 2)
    return R.decode(_examples(links, "test"), vectors, "mlp", model=model)


# --------------------------------------------------------------------------- classification metrics


# labelled rows by part: positives are returned lines, the score is the quantity (many ties)
def _labelled_lines(s: Sources) -> DataFrame:
    return s.table("lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("score"),
    )


_LINES = """y AS MATERIALIZED (SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS label, l_quantity + CAST(l_returnflag = 'R' AS INTEGER) AS score, l_orderkey, l_linenumber FROM lineitem)"""


@query("E1, E2", f"""WITH {_LINES} SELECT l_linestatus, round((sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auroc FROM (
    SELECT *, rank() OVER (PARTITION BY l_linestatus ORDER BY score) + (count(*) OVER (PARTITION BY l_linestatus, score) - 1) / 2 AS r,
        CAST(sum(label) OVER (PARTITION BY l_linestatus) AS DOUBLE) AS p, CAST(count(*) OVER (PARTITION BY l_linestatus) AS DOUBLE) AS n FROM y) GROUP BY l_linestatus, p, n""")
def auroc_by_status(s: Sources) -> DataFrame:
    return E.auroc(_labelled_lines(s), ["l_linestatus"]).withColumn("auroc", F.round("auroc", 9))


@query("E3", f"""WITH {_LINES} SELECT l_linestatus, round(sum(label * tp / k) / sum(label), 9) AS auprc FROM (
    SELECT l_linestatus, label, sum(label) OVER w AS tp, CAST(row_number() OVER w AS DOUBLE) AS k FROM y
    WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC, label DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1""")
def auprc_by_status(s: Sources) -> DataFrame:
    return E.auprc(_labelled_lines(s), ["l_linestatus"]).withColumn("auprc", F.round("auprc", 9))


@query("E2", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS average_rank FROM lineitem""")
def average_ranks(s: Sources) -> DataFrame:
    rows = s.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return E.average_ranks(rows, [], "l_extendedprice").drop("l_extendedprice")


# --------------------------------------------------------------------------- ranking metrics


# all scored links of a customer: quantities as scores; test positives are ranked, known links are filtered
_RANKS = """c AS MATERIALIZED (SELECT d.head, d.tail, d.score, p.split = 'test' AS positive, p.role = 'message' OR p.split = 'test' AS known
    FROM dg d JOIN parts p ON p.edge_type = 'associated_with' AND p.src = d.head AND p.dst = d.tail)"""


def _rank_inputs(s: Sources) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = disease_parts(s)
    scores = s.disease_gene().select(F.col("disease_id").alias("head"), F.lit("associated_with").alias("relation"),
                                     F.col("gene_id").alias("tail"), "score")
    known = as_triples(parts.where("role = 'message' or split = 'test'"))
    return materialize(scores), as_triples(S.supervision_links(parts, "test")), known


def _ranks_sql(filtered: bool) -> str:
    compete = "(a.tail = b.tail OR NOT b.known)" if filtered else "true"
    return f"""SELECT a.head, a.tail, 1.0 + count(*) FILTER (WHERE b.score > a.score AND {compete})
        + 0.5 * count(*) FILTER (WHERE b.score = a.score AND b.tail <> a.tail AND {compete}) AS rank
        FROM c a JOIN c b ON a.head = b.head WHERE a.positive GROUP BY 1, 2"""


@query("E5, E8", with_tables("dg parts", f"SELECT head, tail, CAST(rank AS DOUBLE) AS rank FROM ({_ranks_sql(True)})", _RANKS))
def filtered_ranks(s: Sources) -> DataFrame:
    return E.filtered_ranks(*_rank_inputs(s)).select("head", "tail", "rank")


@query("E5", with_tables("dg parts", f"SELECT head, tail, CAST(rank AS DOUBLE) AS rank FROM ({_ranks_sql(False)})", _RANKS))
def raw_ranks(s: Sources) -> DataFrame:
    return E.filtered_ranks(*_rank_inputs(s), filtered=False).select("head", "tail", "rank")


@query("E4", with_tables("dg parts", f"""SELECT round(avg(CAST(rank <= 1 AS INTEGER)), 9) AS hits_at_1, round(avg(CAST(rank <= 3 AS INTEGER)), 9) AS hits_at_3,
    round(avg(CAST(rank <= 10 AS INTEGER)), 9) AS hits_at_10, round(avg(1 / CAST(rank AS DOUBLE)), 9) AS mrr FROM ({_ranks_sql(True)})""", _RANKS))
def ranking_metrics(s: Sources) -> DataFrame:
    metrics = E.ranking_metrics(E.filtered_ranks(*_rank_inputs(s)))
    return metrics.select(*[F.round(c, 9).alias(c) for c in metrics.columns])


# --------------------------------------------------------------------------- sampled evaluation

PER_POSITIVE = 1000
# the walk of every positive over the indexed tails, the whole of it
def walk_sql(tails: str, scored: str) -> str:
    """Expressions from ``tails`` (a SELECT of all tails) to ``cand`` and ``scored`` (a SELECT over them)."""
    return f"""tails AS MATERIALIZED (SELECT tail, row_number() OVER (ORDER BY tail) - 1 AS pos FROM ({tails})),
    n_tails AS MATERIALIZED (SELECT count(*) AS t FROM tails),
    prime AS MATERIALIZED (SELECT min(p) AS p FROM (SELECT t + unnest(range(500)) AS p FROM n_tails) WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) d(x) WHERE x * x <= p AND p % x = 0)),
    walker AS MATERIALIZED (SELECT seed, src AS head, dst AS true_tail, md5(concat_ws('|', CAST(seed AS VARCHAR), src, edge_type, dst)) AS h
        FROM sup, {_SEED_ROWS} WHERE edge_type = 'associated_with' AND split = 'test'),
    step AS MATERIALIZED (SELECT seed, head, true_tail, j, ((1 + {hexnum('h', 1)} % (p - 1)) * j + {hexnum('h', 16)} % p) % p AS pos
        FROM (SELECT *, unnest(range(p)) AS j FROM walker, prime)),
    drawn AS MATERIALIZED (SELECT seed, head, true_tail, tail FROM (SELECT s.*, t.tail, row_number() OVER (PARTITION BY seed, s.head, true_tail ORDER BY j) AS r
        FROM step s JOIN tails t USING (pos) ANTI JOIN (SELECT head, tail FROM dg) k ON k.head = s.head AND k.tail = t.tail) WHERE r <= {PER_POSITIVE}),
    cand AS MATERIALIZED (SELECT seed, head, tail, max(label) AS label FROM (SELECT seed, head, tail, 0 AS label FROM drawn UNION ALL SELECT seed, head, true_tail, 1 FROM walker) GROUP BY 1, 2, 3),
    scored AS MATERIALIZED ({scored})"""


_WALK = walk_sql("SELECT DISTINCT tail FROM dg", "SELECT c.*, coalesce(p.score, 0) AS score FROM cand c LEFT JOIN mpop p USING (tail)")
_MPOP = """mpop AS MATERIALIZED (SELECT tail, CAST(sum(w) AS DOUBLE) AS score FROM (SELECT dst AS tail, 2 AS w FROM msg WHERE edge_type = 'associated_with'
    UNION ALL SELECT src, 1 FROM msg WHERE edge_type = 'associated_with') GROUP BY 1)"""


def _evaluation_inputs(s: Sources) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts, test positives, all known links, and all tails of the relation."""
    parts = disease_parts(s)
    known = as_triples(parts)
    return parts, as_triples(S.supervision_links(parts, "test")), known, known.select("relation", "tail").distinct()


def _digest(tail: str) -> str:
    return f"CAST(sum({hexnum(f'md5({tail})', 1, 8)}) AS BIGINT)"


@query("E6, N7", with_tables("dg sup msg", f"SELECT seed, head, true_tail, count(*) AS tails, min(tail) AS first_tail, {_digest('tail')} AS digest FROM drawn GROUP BY 1, 2, 3", f"{_MPOP}, {_WALK}"))
def sampled_tails(s: Sources) -> DataFrame:
    """Number and digest of the tails drawn for each positive and seed."""
    _, positives, known, tails = _evaluation_inputs(s)
    drawn = E.sample_tails(positives, known, tails, PER_POSITIVE, SEEDS)
    return drawn.groupBy("seed", "head", "true_tail").agg(
        F.count(F.lit(1)).alias("tails"), F.min("tail").alias("first_tail"), F.sum(hash_number(F.md5("tail"), 1, 8)).alias("digest"))


@query("E7", with_tables("dg sup msg", f"SELECT seed, head, count(*) AS candidates, CAST(sum(label) AS BIGINT) AS positives, {_digest('tail')} AS digest FROM cand GROUP BY 1, 2", f"{_MPOP}, {_WALK}"))
def candidate_triples(s: Sources) -> DataFrame:
    """Number and digest of the candidates of each head and seed."""
    _, positives, known, tails = _evaluation_inputs(s)
    sampled = E.sample_tails(positives, known, tails, PER_POSITIVE, SEEDS)
    return E.candidate_triples(positives, sampled, SEEDS).groupBy("seed", "head").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("label").cast("bigint").alias("positives"), F.sum(hash_number(F.md5("tail"), 1, 8)).alias("digest"))


def _rank_cte(name: str, compete: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT a.seed, a.head, a.tail, 1.0 + count(*) FILTER (WHERE b.score > a.score) + 0.5 * count(*) FILTER (WHERE b.score = a.score AND b.tail <> a.tail) AS rank
        FROM scored a JOIN scored b ON a.seed = b.seed AND a.head = b.head AND (a.tail = b.tail OR {compete}) WHERE a.label = 1 GROUP BY 1, 2, 3)"""


def _rank_cols(name: str) -> str:
    return ", ".join([f"round(avg(CAST(rank <= {k} AS INTEGER)), 9) AS {name}_hits_at_{k}" for k in (1, 3, 10)] + [f"round(avg(1 / CAST(rank AS DOUBLE)), 9) AS {name}_mrr"])


_METRICS = f"""{_rank_cte('rraw', 'true')}, {_rank_cte('rfil', 'b.label = 0')},
    roc AS MATERIALIZED (SELECT seed, CAST(p AS BIGINT) AS num_positives, CAST(n - p AS BIGINT) AS num_negatives, round((sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auroc FROM (
        SELECT *, rank() OVER (PARTITION BY seed ORDER BY score) + (count(*) OVER (PARTITION BY seed, score) - 1) / 2 AS r,
        CAST(sum(label) OVER (PARTITION BY seed) AS DOUBLE) AS p, CAST(count(*) OVER (PARTITION BY seed) AS DOUBLE) AS n FROM scored) GROUP BY seed, p, n),
    prc AS MATERIALIZED (SELECT seed, round(sum(label * tp / k) / sum(label), 9) AS auprc FROM (SELECT seed, label, sum(label) OVER w AS tp, CAST(row_number() OVER w AS DOUBLE) AS k FROM scored
        WINDOW w AS (PARTITION BY seed ORDER BY score DESC, label DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1),
    metrics AS MATERIALIZED (SELECT * FROM roc JOIN prc USING (seed) JOIN (SELECT seed, {_rank_cols('raw')} FROM rraw GROUP BY 1) USING (seed) JOIN (SELECT seed, {_rank_cols('filtered')} FROM rfil GROUP BY 1) USING (seed))"""


def popularity_evaluation(s: Sources) -> DataFrame:
    parts, positives, known, tails = _evaluation_inputs(s)
    scores = R.popularity(as_triples(S.message_links(parts)))
    metrics = E.evaluate_model(lambda c: R.score_by_tail(c, scores), positives, known, tails, PER_POSITIVE, SEEDS)
    rounded = [c for c in metrics.columns if c not in ("seed", "num_positives", "num_negatives")]
    return metrics.select("seed", "num_positives", "num_negatives", *[F.round(c, 9).alias(c) for c in rounded])


@query("E9, B9, B1, E11", with_tables("dg sup msg", "SELECT * FROM metrics", f"{_MPOP}, {_WALK}, {_METRICS}"))
def evaluated_popularity(s: Sources) -> DataFrame:
    """Popularity under the sampled protocol, five seeds in one pass."""
    return popularity_evaluation(s)


@query("E10, §2.12 callbacks")
def evaluated_callback(s: Sources) -> DataFrame:
    """A scorer given as a Python function, evaluated on the validation split."""
    parts = disease_parts(s)
    known = as_triples(parts)

    def by_digits(head, relation, tail):
        return tail.str[-3:].astype("float64") - head.str[1:].astype("float64") % 7

    tails = known.select("relation", "tail").distinct()
    return E.evaluate_split(R.row_scorer(by_digits), parts, known, tails, "val", PER_POSITIVE, SEEDS)


_SUMMARY = "SELECT metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci95, count(*) AS seeds FROM long GROUP BY metric"


@query("E12, E11", with_tables("dg sup msg", _SUMMARY, f"{_MPOP}, {_WALK}, {_METRICS}, long AS (UNPIVOT (SELECT seed, auroc, auprc, filtered_mrr FROM metrics) ON auroc, auprc, filtered_mrr INTO NAME metric VALUE value)"))
def seed_summary(s: Sources) -> DataFrame:
    metrics = popularity_evaluation(s).select("seed", "auroc", "auprc", "filtered_mrr")
    long = E.long_metrics(metrics, ["seed"]).withColumn("model", F.lit("popularity"))
    E.require_seeds(materialize(long))
    out = E.summarize_seeds(long, ["model"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ci95")], "seeds")


# --------------------------------------------------------------------------- ablation reports


# seed metrics derived from the lines: an arm is a ship year, a seed a line number, metrics are shares and means
_ARM_SQL = """raw AS MATERIALIZED (SELECT 'arm ' || l_returnflag || l_linestatus AS arm, l_linenumber AS seed,
        avg(l_discount) AS auroc, avg(l_quantity) / 50 AS auprc, avg(l_tax) AS hits, avg(l_extendedprice) / 100000 AS mrr FROM lineitem GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT arm, seed, 'AUROC' AS metric, auroc AS value FROM raw UNION ALL SELECT arm, seed, 'AUPRC', auprc FROM raw
        UNION ALL SELECT arm, seed, 'Hits@10', hits FROM raw UNION ALL SELECT arm, seed, 'MRR', mrr FROM raw)"""
_REFERENCE = "arm AF"


def arm_metrics(s: Sources) -> DataFrame:
    wide = s.table("lineitem").groupBy(F.concat(F.lit("arm "), "l_returnflag", "l_linestatus").alias("arm"), F.col("l_linenumber").alias("seed")).agg(
        F.avg("l_discount").alias("AUROC"), (F.avg("l_quantity") / 50).alias("AUPRC"),
        F.avg("l_tax").alias("filtered_Hits@10"), (F.avg("l_extendedprice") / 100000).alias("filtered_MRR"),
    )
    long = E.long_metrics(wide, ["arm", "seed"])
    return materialize(A.standardize_metrics(long))


@query("A1, A2", f"WITH {_ARM_SQL} SELECT arm, seed, metric, round(value, 9) AS value FROM m")
def standardized_metrics(s: Sources) -> DataFrame:
    metrics = arm_metrics(s)
    A.check_arms(metrics, [_REFERENCE])
    return metrics.withColumn("value", F.round("value", 9))


_TEST_SQL = f"""d AS (SELECT a.arm, a.value - b.value AS x FROM m a JOIN m b ON b.arm = '{_REFERENCE}' AND a.seed = b.seed AND b.metric = 'AUPRC' WHERE a.metric = 'AUPRC'),
    t AS (SELECT arm, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM d WHERE arm <> '{_REFERENCE}' GROUP BY 1)"""


@query("A3, E12, E13", f"""WITH {_ARM_SQL}, {_TEST_SQL} SELECT m.arm, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS seeds,
    round(any_value(t.t), 5) AS statistic, CASE WHEN m.arm = '{_REFERENCE}' THEN 'reference' ELSE 'tested' END AS status FROM m LEFT JOIN t USING (arm) GROUP BY m.arm, metric""")
def ablation_report(s: Sources) -> DataFrame:
    report = A.finalize_report(arm_metrics(s), _REFERENCE)
    return report.select("arm", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "seeds",
                         F.round("statistic", 5).alias("statistic"), "status")


# p = erfc(|t| / sqrt 2) as the tail of the normal density, integrated by Simpson's rule
_P_SQL = """g AS (SELECT arm, abs(t) AS z, unnest(range(2001)) AS i FROM t WHERE abs(t) < 30),
    p AS (SELECT arm, 1 - sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(i * z / 2000) * (i * z / 2000) / 2)) * z / 2000 / 3 * 2 / sqrt(2 * pi()) AS p FROM g GROUP BY arm, z)"""


@query("E13", f"WITH {_ARM_SQL}, {_TEST_SQL}, {_P_SQL} SELECT arm, n, round(p, 7) AS p_value FROM p JOIN (SELECT arm, count(*) AS n FROM d GROUP BY 1) USING (arm)")
def paired_p_values(s: Sources) -> DataFrame:
    metrics = arm_metrics(s)
    reference = metrics.where(F.col("arm") == _REFERENCE).select("seed", "metric", "value")
    tests = E.paired_significance(metrics, reference).where(F.col("arm") != _REFERENCE)
    return tests.select("arm", "n", F.round("p_value", 7).alias("p_value"))


@query("E14", f"WITH {_ARM_SQL} SELECT round(avg(value) FILTER (WHERE arm = 'arm RF'), 9) AS model_mean, round(avg(value) FILTER (WHERE arm = '{_REFERENCE}'), 9) AS floor_mean, avg(value) FILTER (WHERE arm = 'arm RF') > avg(value) FILTER (WHERE arm = '{_REFERENCE}') AS beats_floor FROM m WHERE metric = 'AUPRC'")
def popularity_floor(s: Sources) -> DataFrame:
    out = E.beats_floor(arm_metrics(s).withColumnRenamed("arm", "model"), "arm RF", _REFERENCE)
    return out.select(F.round("model_mean", 9).alias("model_mean"), F.round("floor_mean", 9).alias("floor_mean"), "beats_floor")


@query("S9, S15, A9", f"""WITH {_ARM_SQL}, c AS (SELECT arm, string_agg(printf('%.3f ± %.3f', mean, std), '|' ORDER BY metric = 'MRR', metric = 'Hits@10', metric = 'AUPRC') AS cells FROM (
    SELECT arm, metric, avg(value) AS mean, stddev_samp(value) AS std FROM m GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT 0 AS a, 0 AS b, '### Report' AS line UNION ALL SELECT 0, 1, '' UNION ALL SELECT 0, 2, '|row|AUROC|AUPRC|Hits@10|MRR|' UNION ALL SELECT 0, 3, '|---|---|---|---|---|'
    UNION ALL SELECT 1, row_number() OVER (ORDER BY arm), '|' || arm || '|' || cells || '|' FROM c)
    SELECT row_number() OVER (ORDER BY a, b) AS line_no, line FROM l""")
def stored_report_table(s: Sources) -> DataFrame:
    """Report metrics stored and read back, as lines of a markdown table without significance marks."""
    folder = scratch(s.spark, "report")
    T.write_report(arm_metrics(s).withColumn("report", F.lit("lines")), folder)
    report = A.finalize_report(T.read_report(s.spark, folder), _REFERENCE).withColumn("p_value", F.lit(1.0))
    return A.markdown_table(report, "Report").withColumn("line_no", F.col("line_no").cast("bigint"))


# three arms each named after a reference arm, from three kinds of lines
def _named_arms(s: Sources, names: tuple[str, ...]) -> DataFrame:
    kinds = ["AF", "NO", "RF"]
    chosen = F.lit(None).cast("string")
    for kind, name in zip(kinds, names):
        chosen = F.when(F.col("arm") == f"arm {kind}", name).otherwise(chosen)
    return arm_metrics(s).withColumn("arm", chosen).where("arm is not null")


def _means_sql(first: str, second: str, positive: str, negative: str) -> str:
    return f"""WITH {_ARM_SQL}, k AS (SELECT avg(value) FILTER (WHERE arm = 'arm {second}') - avg(value) FILTER (WHERE arm = 'arm {first}') AS delta FROM m WHERE metric = 'AUPRC')
        SELECT round(delta, 9) AS delta, CASE WHEN delta > 0 THEN printf('{positive}', delta) ELSE printf('{negative}', delta) END AS narrative FROM k"""


@query("A4, A5", _means_sql("AF", "NO", A._GRAPH_HELPS, A._GRAPH_DOES_NOT))
def features_or_graph_narrative(s: Sources) -> DataFrame:
    out = A.narrative_features_or_graph(_named_arms(s, (A.FEATURES_ARM, A.GRAPH_ARM)))
    return out.withColumn("delta", F.round("delta", 9))


@query("A4, A6", _means_sql("AF", "NO", A._TEXT_HELPS, A._TEXT_DOES_NOT))
def graph_or_text_narrative(s: Sources) -> DataFrame:
    out = A.narrative_graph_or_text(_named_arms(s, (A.GRAPH_ONLY_ARM, A.GRAPH_TEXT_ARM)))
    return out.withColumn("delta", F.round("delta", 9))


@query("A7", f"""WITH {_ARM_SQL}, k AS (SELECT CASE arm WHEN 'arm AF' THEN '{A.HOMOGENEOUS_ARM}' WHEN 'arm NO' THEN '{A.RELATIONAL_ARM}' ELSE '{A.HETEROGENEOUS_ARM}' END AS arm, avg(value) AS mean
    FROM m WHERE metric = 'AUPRC' AND arm IN ('arm AF', 'arm NO', 'arm RF') GROUP BY 1)
    SELECT round(mean, 9) AS delta, printf('{A._BEST_MODEL}', arm) AS narrative FROM k ORDER BY mean DESC LIMIT 1""")
def best_model_narrative(s: Sources) -> DataFrame:
    out = A.narrative_models(_named_arms(s, (A.HOMOGENEOUS_ARM, A.RELATIONAL_ARM, A.HETEROGENEOUS_ARM)))
    return out.withColumn("delta", F.round("delta", 9))
