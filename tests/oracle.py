"""Run registered queries and their SQL side by side and compare every value."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DUCK_TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sorted(rows):
    return sorted(
        (tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def compare(spark, con, sf_dir, run, sql) -> list[str]:
    """Differences in columns, types and values; empty when both agree."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = _sorted(df.select(*names).collect())
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    if sorted(theirs) != names:
        return [f"columns {names} != {sorted(theirs)}"]
    types = dict(zip(theirs, (str(d[1]) for d in rel.description)))
    rows = rel.fetchall()
    at = [theirs.index(n) for n in names]
    want = _sorted([tuple(r[i] for i in at) for r in rows])
    problems = [
        f"type of {n}: {t} != {types[n]}"
        for n, t in ((f.name, f.dataType.simpleString()) for f in df.select(*names).schema)
        if DUCK_TYPES.get(t) != types[n]
    ]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    for g, w in zip(got, want):
        if g != w:
            diff = [(n, str(a)[:80], str(b)[:80]) for n, a, b in zip(names, g, w) if a != b]
            problems.append(f"first difference {diff}")
            break
    return problems


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                print(f"{name}: {run(spark, sf).count()} rows, no SQL")
                continue
            problems = compare(spark, con, sf, run, sql)
            n = len(con.execute(sql).fetchall())
        except Exception as e:
            problems, n = [f"{type(e).__name__}: {str(e)[:700]}"], -1
        bad += bool(problems)
        print(f"{name}: {'; '.join(problems) or 'ok'} ({n} rows, {time.time() - start:.1f}s)", flush=True)
    print(f"{bad} failed")
