"""python -m tests.correctness [name ...]: runs registered queries against their oracles, as the driver does."""

import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(map(repr, (tuple(r[i] for i in order) for r in data)))


def compare(spark, name, f, sql, sf=SF):
    began = time.time()
    df = f(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    said = f"{name}: {len(got)} rows, {time.time() - began:.1f} s"
    if sql is None:
        return True, said + ", no oracle"
    for t in TABLES:
        duckdb.sql(f"create or replace view {t} as from '{sf}/{t}.parquet'")
    found = duckdb.sql(sql)
    want = rows(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns) or got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"{said}: WRONG {sorted(df.columns)} {sorted(found.columns)} {len(got)} {len(want)} {bad}"
    return True, said


def main(names):
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    for name, f in entry.queries().items():
        if not names or any(name.startswith(n) for n in names):
            try:
                print(*compare(spark, name, f, oracles.get(name)), flush=True)
            except Exception as e:
                print(False, name, "FAILED", str(e)[:600].replace("\n", " "), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
