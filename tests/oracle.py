"""Runs registered queries against their SQL statement in DuckDB and compares whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([canon(v) for v in value])
    if isinstance(value, int):
        return str(value)
    return str(value)


def type_class(value):
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    got_rows = spark_df.select(*[f"`{c}`" for c in cols]).collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_raw = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", len(got_rows)
    order = [names.index(c) for c in cols]
    want_rows = [tuple(r[i] for i in order) for r in want_raw]
    got = sorted(tuple(canon(v) for v in r) for r in got_rows)
    want = sorted(tuple(canon(v) for v in r) for r in want_rows)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(bad)} rows differ, cols {cols}, first {bad[:2]}", len(got)
    for c in range(len(cols)):
        a = {type_class(r[c]) for r in got_rows if r[c] is not None}
        b = {type_class(r[c]) for r in want_rows if r[c] is not None}
        if a != b:
            return f"types differ in {cols[c]}: {a} != {b}", len(got)
    return None, len(got)


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from rasterloom.session import get_session

    root = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("sf"):
        root, argv = f"/root/testdata/{argv[0]}", argv[1:]
    spark = get_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not argv or any(q.startswith(a) for a in argv)]
    failed = 0
    for name in wanted:
        t0 = time.time()
        try:
            df = queries[name](spark, root)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                n, problem = len(df.collect()), None
        except Exception as exc:  # report and carry on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        failed += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} rows={n} {time.time() - t0:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted)} checked, {failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
