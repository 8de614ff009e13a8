"""Run registered queries in Spark and in DuckDB and compare rows, columns and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(columns)


def compare(df, con, sql):
    return compare_rows(df.columns, [tuple(r) for r in df.collect()], con, sql)


def compare_rows(columns, rows, con, sql):
    got, got_cols = rows_of(columns, rows)
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} != {len(want)}; only spark {str(extra)[:600]} only sql {str(missing)[:600]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {str(bad[0])[:1200]}" if bad else None


def main(names, sf_dir):
    from callweave.plans import ORACLES, QUERIES
    from callweave.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    con = connect(sf_dir)
    failed = []
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                rows = [tuple(r) for r in df.collect()]
                spark_time = time.time() - start
                problem = compare_rows(df.columns, rows, con, ORACLES[name])
                kind = f"S spark {spark_time:.1f}s"
            else:
                problem, kind = (None if df.count() >= 0 else "?"), "R"
        except Exception as error:  # noqa: BLE001
            problem, kind = f"{type(error).__name__}: {str(error)[:1500]}", "E"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
