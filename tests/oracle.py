"""Compares registered queries with their SQL: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows(columns: list[str], data: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def compare(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the query's rows are those of the SQL."""
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    c.execute(sql)
    theirs = rows([d[0] for d in c.description], c.fetchall())
    if mine == theirs:
        return ""
    differ = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b][:2]
    return f"columns {mine[0]} {theirs[0]}, rows {len(mine[1])} {len(theirs[1])}, {differ}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", 8).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, sql = connect(sys.argv[1]), e.oracle_sql()
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:] or len(sys.argv) == 2 and name.startswith(("op", "pipeline")):
            continue
        began = time.time()
        try:
            if name in sql:
                said = compare(f(spark, sys.argv[1]), db, sql[name]) or "same"
            else:
                said = f"{f(spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as x:
            said = f"FAILED {str(x)[:600]}"
        print(f"{name}: {said[:900]} ({time.time() - began:.1f} s)", flush=True)
