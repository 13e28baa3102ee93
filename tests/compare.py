"""Run registered queries next to their oracles: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("graphrank")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in data)


def differences(spark, con, sf_dir: str, name: str, query, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return "" if got else "no rows"
    only_a, only_b = a - b, b - a
    return (f"rows {len(got)} vs {len(want)}; only spark {sum(only_a.values())} {list(only_a)[:2]}; "
            f"only sql {sum(only_b.values())} {list(only_b)[:2]}")


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = differences(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
