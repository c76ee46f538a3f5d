"""Run a registered query and its checker SQL side by side and compare the rows."""

from __future__ import annotations

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.9g}f"
    return str(value)


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def compare(df, con, sql):
    """Empty text when equal, else a short description of the first difference."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        extra = next((g for g, w in zip(got, want) if g != w), None)
        return f"rows {len(got)} != {len(want)}; first got {extra}; want {next((w for g, w in zip(got, want) if g != w), None)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row got {g}\n     want {w}"
    return "" if got else "no rows"


def main(argv):
    import time

    from intelspark.session import local_session

    import __spark_entry__ as entry

    spark = local_session("check", cores="8")
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    picks = argv[1:]
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            out = compare(df, con, sqls[name]) if name in sqls else f"(rows {df.count()})"
        except Exception as exc:  # report every failure, then go on
            out = f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
        took = time.time() - start
        if out and not out.startswith("(rows"):
            bad += 1
        print(f"{'ok ' if not out or out.startswith('(rows') else 'BAD'} {took:6.2f}s {name} {out}", flush=True)
    print("bad", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
