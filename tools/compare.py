"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tools/compare.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """Comparable form of a value: type name and text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return "f:nan" if math.isnan(value) else f"f:{value!r}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    started = time.time()
    df = run(spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return f"rows-only {len(spark_rows)}", seconds, len(spark_rows) > 0
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    sql_rows = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS spark {sorted(df.columns)} sql {sorted(columns)}", seconds, False
    a, b = rows_of(df.columns, spark_rows), rows_of(columns, sql_rows)
    if a == b:
        return f"equal {len(a)}", seconds, len(a) > 0
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return f"DIFFERENT {sorted(columns)} spark {len(a)} sql {len(b)}\n   spark {only_a}\n   sql   {only_b}", seconds, False


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--module", default=None)
    parser.add_argument("--broadcast", default=None, help="broadcast threshold, e.g. 1KB to take the paths for large tables")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from catalog import QUERIES, SQL

    spark, con = session(), connect(args.sf)
    if args.broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", args.broadcast)
    names = args.names or list(QUERIES)
    if args.module:
        import importlib

        source = pathlib.Path(importlib.import_module(f"catalog.{args.module}").__file__).read_text()
        names = [n for n in QUERIES if f'@query("{n}"' in source]
    bad = []
    for name in names:
        try:
            text, seconds, ok = compare(spark, con, name, QUERIES[name], SQL.get(name), args.sf)
        except Exception as error:  # report and go on with the next query
            text, seconds, ok = f"ERROR {type(error).__name__}: {str(error)[:700]}", 0.0, False
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {seconds:6.2f}s {name}: {text}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
