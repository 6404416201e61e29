"""Side-by-side run of registered queries and their DuckDB texts."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def connection(folder: str):
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    con.execute("SET TimeZone='UTC'")
    return con


def canon(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def check(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, folder)
    columns, got = df.columns, [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return f"rows-only {len(got)}", spent
    start = time.time()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    duck = time.time() - start
    if sorted(columns) != sorted(names):
        return f"COLUMNS {columns} vs {names}", spent
    a, b = rows_of(columns, got), rows_of(names, want)
    if a == b:
        flag = "" if got else " EMPTY"
        types = ",".join(t for _, t in df.dtypes if "decimal" in t)
        return f"ok {len(got)}{flag}{' DECIMAL ' + types if types else ''} duck {duck:.1f}s", spent
    sa, sb = set(a), set(b)
    return f"DIFF spark {len(a)} duck {len(b)} only-spark {list(sa - sb)[:3]} only-duck {list(sb - sa)[:3]}", spent


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from winnow.session import local_session

    spark = local_session()
    con = connection(SF)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    bad = 0
    for name in names:
        try:
            verdict, spent = check(spark, con, name, queries[name], oracles.get(name), SF)
        except Exception as error:  # noqa: BLE001
            verdict, spent = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:28s} {spent:6.1f}s {verdict}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
