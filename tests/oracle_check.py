"""Compare registered queries with their DuckDB twins: python -m tests.oracle_check SF_DIR [NAME ...]"""

import glob
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _key(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, int) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """None if rows are equal, or what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, cur.fetchall())
    if got == want:
        return None
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
    return f"{len(got)} and {len(want)} rows; {odd}"


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = connect(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            if name in oracles:
                said = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                print(f"rows-only {name}: {n} rows, {time.time() - began:.1f} s", flush=True)
                continue
        except Exception:
            said = "\n".join(x for x in traceback.format_exc().splitlines() if not x.lstrip().startswith("at "))[-1500:]
        bad += said is not None
        print(f"{'ok' if said is None else 'DIFFERS'} {name} {time.time() - began:.1f} s {said or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
