"""Runs registered queries next to their SQL in DuckDB and compares the rows.

    python tests/oracle_check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import logging
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp": "TIMESTAMP"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str, plans: list | None = None) -> str | None:
    """None when equal, else what differs.  ``plans`` collects the text of the planned query."""
    df = fn(spark, sf_dir)
    if plans is not None:
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {n: str(t) for n, t in zip(names, [d[0] for d in con.execute(f"SELECT column_type FROM (DESCRIBE {sql})").fetchall()])}
    bad = [(n, t, kinds[n]) for n, t in df.dtypes if TYPES.get(t, t) != kinds[n]]
    if bad:
        return f"types {bad}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, first {diff[0]}"
    return None if got else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from borgata.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
