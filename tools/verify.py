"""Compare registered queries with their oracles: tools/verify.py [folder] [name-prefix ...]"""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


# queries without SQL, by name
ROWS_ONLY = {"txt_tune_k"}


def session(cpus="8"):
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def cell(v):
    if isinstance(v, float):
        # as text: NaN equals itself, and 0.0 differs from -0.0
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    typed = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(typed, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, folder, queries, oracles):
    df = queries[name](spark, folder)
    names, rows = canonical(df.columns, df.collect())
    if name not in oracles:
        return f"rows-only {len(rows)}"
    cur = con.execute(oracles[name])
    onames, orows = canonical([d[0] for d in cur.description], cur.fetchall())
    if names != onames:
        return f"COLUMNS {names} != {onames}"
    if len(rows) != len(orows):
        return f"ROWS {len(rows)} != {len(orows)}; spark {rows[:2]} oracle {orows[:2]}"
    bad = [(a, b) for a, b in zip(rows, orows) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"VALUES {len(bad)} of {len(rows)} differ, first {bad[0]}"
    return f"ok {len(rows)}"


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


if __name__ == "__main__":
    from granary.catalog import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = session(), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, folder, QUERIES, ORACLES)
        except Exception as e:  # report and go on to the next query
            result = f"ERROR {type(e).__name__} {str(e)[:600]}"
        failed += not result.startswith("rows-only" if name in ROWS_ONLY else "ok")
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed:", failed)
