"""Compare registered queries with their SQL in DuckDB: `python tests/oracle.py [names...]`."""

from __future__ import annotations

import collections
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def local_session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("PARTITIONS", "8"))
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.log.level", "ERROR")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("f", value + 0.0)
    return value if value is None or isinstance(value, (int, str, bool)) else ("?", type(value).__name__, str(value))


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), collections.Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    rows = df.collect()
    if sql is None:
        return len(rows), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    left, right = bag(df.columns, rows), bag(names, cur.fetchall())
    if left[0] != right[0]:
        return len(rows), f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        only_left, only_right = list((left[1] - right[1]).items())[:3], list((right[1] - left[1]).items())[:3]
        return len(rows), f"{sum((left[1]-right[1]).values())} rows differ\n   spark {only_left}\n   sql   {only_right}"
    return len(rows), ""


def main(names):
    import __spark_entry__ as entry

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in names or queries:
        start = time.time()
        try:
            n, problem = compare(spark, con, queries[name], oracles.get(name), sf_dir)
            word = "rows" if problem is None else "ok" if not problem else "DIFF"
        except Exception as e:
            n, word, problem = 0, "FAIL", str(e)[:1500] if os.environ.get("SHORT", "1") == "1" else traceback.format_exc()
        bad += word in ("DIFF", "FAIL")
        print(f"{word:5}{time.time() - start:7.2f}s {n:8} {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
