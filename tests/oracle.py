"""Runs queries beside their SQL in DuckDB and tells which differ: python tests/oracle.py [SF_DIR [NAME...]]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return list(frame.columns), sorted(tuple(str(v) for v in r) for r in frame.itertuples(index=False))


def differs(spark, con, query, sql, sf_dir):
    """None if both agree, else what differs."""
    a, b = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).df())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(bad)} of {len(a[1])} rows, as {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    for name, f in entry.queries().items():
        if name in sql and (len(sys.argv) < 3 or name in sys.argv[2:]):
            began = time.time()
            try:
                said = differs(session, connect(sf_dir), f, sql[name], sf_dir)
            except Exception as e:
                said = f"{type(e).__name__}: {str(e)[:400]}"
            print(f"{'ok  ' if said is None else 'BAD '}{name} {time.time() - began:.1f} s {said or ''}", flush=True)
