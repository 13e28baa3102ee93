"""Queries over link splits and negative sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrank.catalog.columns import scratch
from graphrank.catalog.registry import query
from graphrank.catalog.sql import hexnum, negatives, with_tables
from graphrank.operators import graph as G
from graphrank.operators import negatives as N
from graphrank.operators import splits as S
from graphrank.plans.binding import Sources
from graphrank.plans.lineage import materialize
from graphrank.schemas import PREDICTED_RELATIONS
from graphrank.sources import tables as T


def links_of(s: Sources, *tables: str) -> DataFrame:
    edges = s.edges(*(tables or ("disease_gene", "drug_gene", "gene_pathway")))
    return edges.select("edge_type", F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


@query("N1, N2", with_tables("parts", "SELECT edge_type, src, dst, split, role FROM parts"))
def link_parts(s: Sources) -> DataFrame:
    return S.partition_links(links_of(s), S.SplitOptions())


@query("N4", with_tables("edges msg", """SELECT e.rel AS edge_type, e.head AS source_id, e.tail AS target_id FROM edges e WHERE rel NOT IN ('associated_with', 'targets', 'participates_in')
    UNION ALL SELECT edge_type, src, dst FROM msg"""))
def message_graph(s: Sources) -> DataFrame:
    edges = s.stored_edges().select("edge_type", "source_id", "target_id")
    links = edges.where(F.col("edge_type").isin(*PREDICTED_RELATIONS))
    parts = S.partition_links(links.select("edge_type", F.col("source_id").alias("src"), F.col("target_id").alias("dst")), S.SplitOptions())
    return S.message_graph(edges, parts)


def _stage(split: str, blocked: str, ratio: int) -> str:
    """Negatives of one split: restricted to its own ends, or unrestricted where those are too few."""
    wanted = f"SELECT edge_type, count(*) * {ratio} AS n FROM sup WHERE split = '{split}' GROUP BY 1"
    if split == "train":
        return negatives("neg_train", split, "SELECT edge_type, src AS id FROM links", "SELECT edge_type, dst AS id FROM links", wanted, blocked)
    own = negatives(f"own_{split}", split, f"SELECT edge_type, src AS id FROM sup WHERE split = '{split}'",
                    f"SELECT edge_type, dst AS id FROM sup WHERE split = '{split}'", wanted, blocked)
    short = f"""SELECT w.edge_type, w.n FROM ({wanted}) w LEFT JOIN (SELECT edge_type, count(*) AS c FROM own_{split} GROUP BY 1) o USING (edge_type) WHERE coalesce(c, 0) < w.n"""
    wide = negatives(f"wide_{split}", split, "SELECT edge_type, src AS id FROM links", "SELECT edge_type, dst AS id FROM links", short, blocked)
    return f"""{own}, short_{split} AS MATERIALIZED ({short}), {wide}, neg_{split} AS MATERIALIZED (
        SELECT * FROM own_{split} WHERE edge_type NOT IN (SELECT edge_type FROM short_{split}) UNION ALL SELECT * FROM wide_{split})"""


_BLOCK = "SELECT edge_type, src, dst FROM links"
SPLIT_SQL = ", ".join([
    _stage("train", _BLOCK, 1),
    _stage("val", f"{_BLOCK} UNION ALL SELECT edge_type, src, dst FROM neg_train", 10),
    _stage("test", f"{_BLOCK} UNION ALL SELECT edge_type, src, dst FROM neg_train UNION ALL SELECT edge_type, src, dst FROM neg_val", 10),
    """labelled AS MATERIALIZED (SELECT edge_type, src, dst, split, role, 1 AS label FROM parts
    UNION ALL SELECT edge_type, src, dst, 'train', 'supervision', 0 FROM neg_train
    UNION ALL SELECT edge_type, src, dst, 'val', 'supervision', 0 FROM neg_val
    UNION ALL SELECT edge_type, src, dst, 'test', 'supervision', 0 FROM neg_test)""",
])


@query("N3, N5, N8, N11, N7", with_tables("links parts sup", "SELECT edge_type, src, dst, split, role, label FROM labelled", SPLIT_SQL))
def split_links(s: Sources) -> DataFrame:
    return S.split_links(links_of(s))


@query("N13, S8", with_tables("links parts sup", "SELECT CAST(13 AS INTEGER) AS seed, edge_type, split, role, label, count(*) AS links FROM labelled GROUP BY ALL", SPLIT_SQL))
def stored_split_counts(s: Sources) -> DataFrame:
    folder, options = scratch(s.spark, "splits"), S.SplitOptions()
    links = S.split_links(links_of(s), options)
    T.save_splits(links, S.split_metadata(options, links), folder)
    stored, _ = T.load_splits(s.spark, folder)
    return S.split_metadata(options, stored).select("seed", "edge_type", "split", "role", "label", "links")


_RULES = "('positives_in_two_splits'), ('supervision_in_messages'), ('negatives_in_two_splits'), ('negatives_that_are_positive')"


@query("N12", with_tables("links", f"SELECT edge_type, rule, CAST(0 AS BIGINT) AS violations FROM (SELECT DISTINCT edge_type FROM links), (VALUES {_RULES}) r(rule)"))
def split_audit(s: Sources) -> DataFrame:
    return S.audit_splits(S.split_links(links_of(s)))


@query("N6", with_tables("sup", "SELECT edge_type, src, dst FROM sup WHERE split = 'val'"))
def validation_positives(s: Sources) -> DataFrame:
    parts = S.partition_links(links_of(s), S.SplitOptions()).withColumn("label", F.lit(1))
    return S.supervision_links(parts, "val", 1).select("edge_type", "src", "dst")


# --------------------------------------------------------------------------- strategies


def _pair_space(s: Sources, *tables: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = materialize(links_of(s, *tables))
    return links.select("edge_type", F.col("src").alias("id")), links.select("edge_type", F.col("dst").alias("id")), links


_TWO = "l2 AS MATERIALIZED (SELECT * FROM links WHERE edge_type IN ('associated_with', 'participates_in'))"
_HEADS, _TAILS, _ALL = "SELECT edge_type, src AS id FROM l2", "SELECT edge_type, dst AS id FROM l2", "SELECT edge_type, src, dst FROM l2"
_WANT = "SELECT 'associated_with' AS edge_type, 5000 AS n UNION ALL SELECT 'participates_in', 100000000"


@query("N7, N8", with_tables("links", "SELECT edge_type, src, dst FROM neg", f"{_TWO}, {negatives('neg', 'random', _HEADS, _TAILS, _WANT, _ALL)}"))
def random_negatives(s: Sources) -> DataFrame:
    """One relation sampled, the other asked for more than there are: all its pairs come back."""
    heads, tails, links = _pair_space(s, "disease_gene", "gene_pathway")
    return N.sample_negatives(heads, tails, links, {"associated_with": 5000, "participates_in": 100_000_000}, 13, "random")


_DEGREE_SQL = """l1 AS MATERIALIZED (SELECT src, dst FROM links WHERE edge_type = 'associated_with'),
    hs AS MATERIALIZED (SELECT src, d, row_number() OVER (ORDER BY d DESC, md5(concat_ws('|', '13', 'src', 'associated_with', src))) AS i FROM (SELECT src, count(*) AS d FROM l1 GROUP BY 1)),
    ts AS MATERIALIZED (SELECT dst, d, row_number() OVER (ORDER BY d DESC, md5(concat_ws('|', '13', 'dst', 'associated_with', dst))) AS i FROM (SELECT dst, count(*) AS d FROM l1 GROUP BY 1))"""


@query("N9", with_tables("links", """SELECT 'associated_with' AS edge_type, src, dst FROM (SELECT hs.src, ts.dst, hs.d + ts.d AS total, hs.i * ts.i AS area FROM hs, ts) p
    ANTI JOIN l1 USING (src, dst) ORDER BY total DESC, area, md5(concat_ws('|', '13', 'degree', 'associated_with', src, dst)) LIMIT 4000""", _DEGREE_SQL))
def degree_negatives(s: Sources) -> DataFrame:
    heads, tails, links = _pair_space(s, "disease_gene")
    ends = F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")))
    degrees = links.select("edge_type", F.explode(ends).alias("_e")).groupBy("edge_type", "_e.side", "_e.id").agg(F.count(F.lit(1)).alias("degree"))
    return N.sample_negatives(heads, tails, links, {"associated_with": 4000}, 13, "degree", "degree_matched", degrees)


_HARD_SQL = f"""{_TWO}, {negatives('neg', 'hard', _HEADS, _TAILS, "SELECT 'participates_in' AS edge_type, 3000 AS n", _ALL)},
    hard AS MATERIALIZED (SELECT DISTINCT l.src, gg.tail AS dst FROM l2 l JOIN gg ON gg.head = l.dst WHERE l.edge_type = 'associated_with' AND gg.tail IN (SELECT dst FROM l2 WHERE edge_type = 'associated_with'))"""


@query("N10", with_tables("links gg", """SELECT 'associated_with' AS edge_type, src, dst FROM (SELECT h.src, h.dst FROM hard h ANTI JOIN (SELECT src, dst FROM l2 WHERE edge_type = 'associated_with') k USING (src, dst)
    ORDER BY md5(concat_ws('|', '13', 'hard', 'associated_with', src, dst)) LIMIT 2000) UNION ALL SELECT edge_type, src, dst FROM neg""", _HARD_SQL))
def hard_negatives(s: Sources) -> DataFrame:
    """Hard pairs: genes linked to a known gene of the same head; the other relation has none and is topped up."""
    heads, tails, links = _pair_space(s, "disease_gene", "gene_pathway")
    hard = links.where("edge_type = 'associated_with'").join(
        s.gene_gene().select(F.col("gene_a").alias("dst"), F.col("gene_b").alias("near")), "dst"
    ).select("edge_type", "src", F.col("near").alias("dst"))
    wanted = {"associated_with": 2000, "participates_in": 3000}
    return N.sample_negatives(heads, tails, links, wanted, 13, "hard", "hard", hard_pairs=hard)


def _move(k: int, half: str) -> str:
    return hexnum(f"md5(concat_ws('|', '13', 'two', '{k}', CAST({half} AS VARCHAR)))")


_TWO_STEPS = f"""l1 AS MATERIALIZED (SELECT src, dst FROM links WHERE edge_type = 'associated_with'),
    hd AS MATERIALIZED (SELECT dst AS mid, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS s, count(*) OVER (PARTITION BY dst) AS hn FROM l1),
    tl AS MATERIALIZED (SELECT head AS mid, tail AS dst, row_number() OVER (PARTITION BY head ORDER BY tail) - 1 AS d, count(*) OVER (PARTITION BY head) AS tn
        FROM (SELECT DISTINCT head, tail FROM gg) WHERE tail IN (SELECT dst FROM l1)),
    way AS MATERIALIZED (SELECT src, tl.dst, row_number() OVER (ORDER BY mid, s, d) - 1 AS place FROM hd JOIN tl USING (mid)),
    z AS MATERIALIZED (SELECT count(*) AS n, CAST(ceil(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS l FROM way),
    s0 AS MATERIALIZED (SELECT l, r, j, j // r AS x, j % r AS y FROM (SELECT l, (n + l - 1) // l AS r, unnest(range(l * ((n + l - 1) // l))) AS j FROM z)),
    s1 AS MATERIALIZED (SELECT * REPLACE ((x + {_move(0, 'y')} % l) % l AS x) FROM s0), s2 AS MATERIALIZED (SELECT * REPLACE ((y + {_move(1, 'x')} % r) % r AS y) FROM s1),
    s3 AS MATERIALIZED (SELECT * REPLACE ((x + {_move(2, 'y')} % l) % l AS x) FROM s2), s4 AS MATERIALIZED (SELECT * REPLACE ((y + {_move(3, 'x')} % r) % r AS y) FROM s3)"""


@query("N10", with_tables("links gg", """SELECT src, dst FROM (SELECT src, dst, min(j) AS j FROM s4 JOIN way ON place = x * r + y
    ANTI JOIN l1 USING (src, dst) WHERE src <> dst GROUP BY 1, 2) ORDER BY j LIMIT 3000""", _TWO_STEPS))
def sampled_hard_pairs(s: Sources) -> DataFrame:
    """Genes two steps from a disease, drawn by their ways without listing them."""
    _, tails, links = _pair_space(s, "disease_gene")
    near = s.gene_gene().select(F.col("gene_a").alias("a"), F.col("gene_b").alias("b"))
    return N.sample_hard_pairs(links, near, links, 3000, 13, "two", tails)


@query("C19, G17", with_tables("parts", "SELECT edge_type, count(*) AS links FROM parts GROUP BY 1"))
def predicted_relations(s: Sources) -> DataFrame:
    typed = G.typed_edges(s.edges("disease_gene", "drug_gene", "gene_pathway"))
    return typed.groupBy(F.col("relation").alias("edge_type")).agg(F.count(F.lit(1)).alias("links"))
