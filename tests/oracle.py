"""Compare registered queries with DuckDB.  Usage: python tests/oracle.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def type_name(t) -> str:
    return str(t).replace("large_", "").replace("timestamp[us, tz=UTC]", "timestamp[us]")


def canonical(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, {n: type_name(table.schema.field(n).type) for n in names}, sorted(map(repr, zip(*columns)))


def compare(got, want) -> str | None:
    """None when equal, else what differs."""
    g, w = canonical(got), canonical(want)
    if g[0] != w[0]:
        return f"columns {g[0]} != {w[0]}"
    types = {n: (g[1][n], w[1][n]) for n in g[0] if g[1][n] != w[1][n]}
    if types:
        return f"types {types}"
    if len(g[2]) != len(w[2]):
        return f"rows {len(g[2])} != {len(w[2])}"
    diff = [(a, b) for a, b in zip(g[2], w[2]) if a != b]
    if diff:
        return f"{len(diff)} of {len(g[2])} rows differ, e.g. {diff[0][0][:400]} != {diff[0][1][:400]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            t0 = time.time()
            got = run(spark, sf_dir).toArrow()
            t1 = time.time()
            if name in sql:
                want = con.sql(sql[name]).to_arrow_table()
                problem = compare(got, want)
            else:
                problem = None if got.num_rows else "no rows"
            bad += problem is not None
            print(f"{'ok  ' if problem is None else 'FAIL'} {name:34s} {got.num_rows:7d} rows spark {t1 - t0:5.1f}s sql {time.time() - t1:5.1f}s {'' if name in sql else '(rows only) '}{problem or ''}", flush=True)
        except Exception as exc:  # report and go on to the next query
            bad += 1
            print(f"FAIL {name:34s} {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    sys.exit(1 if main(sys.argv[1:]) else 0)
