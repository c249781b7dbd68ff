"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

Usage: python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _kind(name: str) -> str:
    name = name.lower()
    if name in ("bigint", "int", "integer", "long", "smallint", "tinyint", "short", "byte", "ubigint", "uinteger"):
        return "int"
    if name in ("double", "float", "real"):
        return "float"
    if name in ("string", "varchar"):
        return "string"
    if name.startswith("timestamp"):
        return "timestamp"
    return name


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """'' when both results are equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    got_types = {n: _kind(t) for n, t in df.dtypes}
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_types = {d[0]: _kind(str(d[1])) for d in rel.description}
    want = rel.fetchall()
    cols = sorted(got_types)
    if cols != sorted(names):
        return f"columns {cols} vs {sorted(names)}"
    bad = [(c, got_types[c], want_types[c]) for c in cols if got_types[c] != want_types[c]]
    got = df.select(*cols).collect()
    order = [names.index(c) for c in cols]
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    a = sorted((tuple(_norm(v) for v in row) for row in got), key=key)
    b = sorted((tuple(_norm(row[i]) for i in order) for row in want), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; types {bad}; only spark {list(set(a) - set(b))[:3]} only sql {list(set(b) - set(a))[:3]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, columns {cols}, first {diff[:3]}; types {bad}"
    return f"types {bad}" if bad else ""


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else SF
    import __spark_entry__ as entry
    from ridgewater.session import local_session

    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        start = time.time()
        try:
            if name in oracles:
                message = compare(spark, con, queries[name], oracles[name], sf_dir)
                rows = ""
            else:
                rows = f"rows-only {len(queries[name](spark, sf_dir).collect())}"
                message = ""
        except Exception as error:  # noqa: BLE001
            message, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failed += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name:28s} {time.time() - start:6.1f}s {rows} {message}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
