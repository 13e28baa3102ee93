"""SQL fragments shared by the oracle statements: the bound tables as common table expressions."""

from __future__ import annotations


def gene(number: str) -> str:
    return f"'ENSG' || lpad(CAST({number} AS VARCHAR), 11, '0')"


def hexnum(digest: str, start: int = 1, digits: int = 15) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {digits}) AS BIGINT)"


CTES = {
    "dg": f"""SELECT 'C' || o_custkey AS head, {gene('l_partkey')} AS tail, sum(l_quantity) AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "pl": """SELECT '9606.ENSP' || l_partkey AS a, '9606.ENSP' || (l_suppkey * 20) AS b, l_partkey AS ka,
        l_suppkey * 20 AS kb, 20 * sum(l_quantity) AS score FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "gg": f"""SELECT {gene('ka')} AS head, {gene('kb')} AS tail, score FROM pl
        WHERE score >= 700 AND ka <> kb AND ka IN (SELECT p_partkey FROM part) AND kb IN (SELECT p_partkey FROM part)""",
    "gp": f"SELECT DISTINCT {gene('l_partkey')} AS head, 'R-HSA-S' || l_suppkey AS tail FROM lineitem",
    "pp": """SELECT 'R-HSA-R' || n_regionkey AS head, 'R-HSA-N' || n_nationkey AS tail FROM nation
        UNION SELECT 'R-HSA-N' || s_nationkey, 'R-HSA-S' || s_suppkey FROM supplier""",
    "acc": f"""SELECT p_partkey AS k, {gene('p_partkey')} AS g FROM part
        UNION SELECT p_partkey, {gene('p_partkey + 1')} FROM part WHERE p_size % 5 = 0""",
    "dr": """SELECT 'CHEMBL' || l_orderkey AS head, g AS tail, 'CHEMBL_T' || l_partkey AS target,
        l_returnflag AS action, 'line status ' || l_linestatus AS mechanism FROM lineitem JOIN acc ON l_partkey = k""",
    "dr1": """SELECT head, tail, split_part(m, '|', 1) AS target, split_part(m, '|', 2) AS action,
        split_part(m, '|', 3) AS mechanism
        FROM (SELECT head, tail, min(target || '|' || action || '|' || mechanism) AS m FROM dr GROUP BY head, tail)""",
    "go": """SELECT g AS head, 'GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS tail, min(p_brand) AS evidence
        FROM part JOIN acc ON p_partkey = k GROUP BY 1, 2""",
    "edges": """SELECT 'disease_gene' AS edge_table, head, 'Disease' AS st, 'associated_with' AS rel, 'Gene' AS tt, tail FROM dg
        UNION ALL SELECT 'gene_gene', head, 'Gene', 'interacts', 'Gene', tail FROM gg
        UNION ALL SELECT 'gene_pathway', head, 'Gene', 'participates_in', 'Pathway', tail FROM gp
        UNION ALL SELECT 'drug_gene', head, 'Drug', 'targets', 'Gene', tail FROM dr1
        UNION ALL SELECT 'gene_go', head, 'Gene', 'annotated_with', 'GOTerm', tail FROM go
        UNION ALL SELECT 'pathway_pathway', head, 'Pathway', 'parent_of', 'Pathway', tail FROM pp""",
    "nodes": """SELECT st AS node_type, head AS node_id FROM edges UNION SELECT tt, tail FROM edges""",
    "typed": """SELECT CASE st WHEN 'GOTerm' THEN 'go_term' ELSE lower(st) END AS st, rel,
        CASE tt WHEN 'GOTerm' THEN 'go_term' ELSE lower(tt) END AS tt, head, tail FROM edges""",
    "typed2": """SELECT st, rel, tt, head, tail FROM typed
        UNION ALL SELECT tt, 'rev_' || rel, st, tail, head FROM typed WHERE rel <> 'interacts'""",
    "pop": """SELECT tail, CAST(sum(w) AS DOUBLE) AS score FROM (SELECT tail, 2 AS w FROM dg
        UNION ALL SELECT head, 1 FROM dg) GROUP BY tail""",
    # disjoint parts of the predicted links, by md5 rank per relation
    "links": """SELECT 'associated_with' AS edge_type, head AS src, tail AS dst FROM dg
        UNION ALL SELECT 'targets', head, tail FROM dr1 UNION ALL SELECT 'participates_in', head, tail FROM gp""",
    "placed": """SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY md5(concat_ws('|', '13', edge_type, src, dst))) AS rn,
        count(*) OVER (PARTITION BY edge_type) AS n FROM links""",
    "sized": """SELECT edge_type, src, dst, rn, n, nt, nv, greatest(1, CAST(round_even((n - nt - nv) * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) AS ns
        FROM (SELECT *, CAST(round_even((n - nt) * CAST(0.1 AS DOUBLE), 0) AS BIGINT) AS nv
              FROM (SELECT *, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT) AS nt FROM placed))""",
    "parts": """SELECT edge_type, src, dst,
        CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'val' ELSE 'train' END AS split,
        CASE WHEN rn <= nt + nv + ns THEN 'supervision' ELSE 'message' END AS role FROM sized""",
    "sup": "SELECT edge_type, src, dst, split FROM parts WHERE role = 'supervision'",
    "msg": "SELECT edge_type, src, dst FROM parts WHERE role = 'message'",
}
# names each expression reads, so that a statement carries only what it needs
_READS = {
    "gg": ["pl"], "dr": ["acc"], "dr1": ["dr"], "go": ["acc"],
    "edges": ["dg", "gg", "gp", "dr1", "go", "pp"], "nodes": ["edges"], "typed": ["edges"], "typed2": ["typed"],
    "pop": ["dg"], "links": ["dg", "dr1", "gp"], "placed": ["links"], "sized": ["placed"], "parts": ["sized"],
    "sup": ["parts"], "msg": ["parts"],
}


def with_tables(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` the named expressions and all they read, then ``extra`` expressions, then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for read in _READS.get(name, []):
            add(read)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def negatives(name: str, stage: str, heads: str, tails: str, wanted: str, blocked: str, seed: int = 13) -> str:
    """Expressions ``{name}`` = sampled negatives of one stage; arguments are SELECT texts.

    heads and tails give (edge_type, id), wanted (edge_type, n), blocked (edge_type, src, dst).
    """
    def move(k: int, half: str) -> str:
        digest = f"md5(concat_ws('|', CAST({seed} AS VARCHAR), '{stage}', edge_type, '{k}', CAST({half} AS VARCHAR)))"
        return hexnum(digest)

    return f"""
    {name}_h AS MATERIALIZED (SELECT edge_type, id, row_number() OVER (PARTITION BY edge_type ORDER BY id) - 1 AS idx
        FROM (SELECT DISTINCT edge_type, id FROM ({heads}))),
    {name}_t AS MATERIALIZED (SELECT edge_type, id, row_number() OVER (PARTITION BY edge_type ORDER BY id) - 1 AS idx
        FROM (SELECT DISTINCT edge_type, id FROM ({tails}))),
    {name}_b AS MATERIALIZED (SELECT DISTINCT edge_type, src, dst FROM ({blocked})),
    {name}_z AS MATERIALIZED (SELECT w.edge_type, w.n, s.c AS s, t.c AS t, coalesce(b.c, 0) AS f FROM ({wanted}) w
        JOIN (SELECT edge_type, count(*) AS c FROM {name}_h GROUP BY 1) s USING (edge_type)
        JOIN (SELECT edge_type, count(*) AS c FROM {name}_t GROUP BY 1) t USING (edge_type)
        LEFT JOIN (SELECT edge_type, count(*) AS c FROM {name}_b GROUP BY 1) b USING (edge_type) WHERE w.n > 0),
    {name}_d AS MATERIALIZED (SELECT *, s * t AS pairs, CAST(ceil(sqrt(CAST(s * t AS DOUBLE))) AS BIGINT) AS l FROM {name}_z),
    {name}_w AS MATERIALIZED (SELECT *, (pairs + l - 1) // l AS r FROM {name}_d),
    {name}_0 AS MATERIALIZED (SELECT edge_type, t, n, pairs, l, r, j, j // r AS x, j % r AS y
        FROM (SELECT *, unnest(range(least(l * r, n + f + l * r - pairs))) AS j FROM {name}_w)),
    {name}_1 AS MATERIALIZED (SELECT * REPLACE ((x + {move(0, 'y')} % l) % l AS x) FROM {name}_0),
    {name}_2 AS MATERIALIZED (SELECT * REPLACE ((y + {move(1, 'x')} % r) % r AS y) FROM {name}_1),
    {name}_3 AS MATERIALIZED (SELECT * REPLACE ((x + {move(2, 'y')} % l) % l AS x) FROM {name}_2),
    {name}_4 AS MATERIALIZED (SELECT * REPLACE ((y + {move(3, 'x')} % r) % r AS y) FROM {name}_3),
    {name}_j AS MATERIALIZED (SELECT edge_type, t, n, j, x * r + y AS place FROM {name}_4 WHERE x * r + y < pairs),
    {name}_p AS MATERIALIZED (SELECT j.edge_type, j.j, h.id AS src, t.id AS dst FROM {name}_j j
        JOIN {name}_h h ON h.edge_type = j.edge_type AND h.idx = j.place // j.t
        JOIN {name}_t t ON t.edge_type = j.edge_type AND t.idx = j.place % j.t),
    {name} AS MATERIALIZED (SELECT q.edge_type, q.src, q.dst FROM (
        SELECT p.*, row_number() OVER (PARTITION BY p.edge_type ORDER BY p.j) AS r
        FROM {name}_p p ANTI JOIN {name}_b b USING (edge_type, src, dst)) q
        JOIN {name}_z z USING (edge_type) WHERE q.r <= z.n)"""
