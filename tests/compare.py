"""Runs registered queries beside their DuckDB SQL: python tests/compare.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, sf_dir):
    import __spark_entry__ as e

    began = time.time()
    df = e.queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    sql = e.oracle_sql().get(name)
    if sql is None:
        return len(mine), None, took
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    want = rows_of(cols, got.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(mine), f"columns {sorted(df.columns)} against {sorted(cols)}", took
    if mine == want:
        return len(mine), "same", took
    diff = [(a, b) for a, b in zip(mine, want) if a != b][:2]
    return len(mine), f"DIFFERENT: {len(want)} rows wanted, {diff}", took


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:] or e.queries():
        try:
            print(n, *compare(spark, n, sys.argv[1]), flush=True)
        except Exception as x:
            print(n, "ERROR", str(x)[:1500], flush=True)
