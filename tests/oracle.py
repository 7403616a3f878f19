"""Run registered queries next to their oracle SQL and compare schema and exact values."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kind(type_) -> str:
    text = str(type_)
    return {"large_string": "string", "timestamp[us, tz=UTC]": "timestamp[us]"}.get(text, text)


def _key(row):
    return tuple((v is None, str(type(v)), repr(v)) if not isinstance(v, float) else (False, "f", v) for v in row)


def compare(left, right) -> str | None:
    """First difference between two Arrow tables, ignoring row and column order; None when equal."""
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return f"columns {names} != {sorted(right.column_names)}"
    types = [(n, _kind(left.schema.field(n).type), _kind(right.schema.field(n).type)) for n in names]
    bad = [t for t in types if t[1] != t[2]]
    if bad:
        return f"types {bad}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} != {right.num_rows}"
    a = sorted(zip(*[left.column(n).to_pylist() for n in names]), key=repr)
    b = sorted(zip(*[right.column(n).to_pylist() for n in names]), key=repr)
    diff = 0
    first = None
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            diff += 1
            first = first or (x, y)
    return f"{diff} of {len(a)} rows differ, first {names} spark={first[0]} oracle={first[1]}" if diff else None


def run(spark, folder: str, names=None, verbose: bool = True) -> dict[str, str | None]:
    from marketloom.queries import ORACLES, QUERIES

    con = connect(folder)
    result: dict[str, str | None] = {}
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toArrow()
            took = time.time() - start
            if name in ORACLES:
                t1 = time.time()
                want = con.execute(ORACLES[name]).to_arrow_table()
                duck = time.time() - t1
                problem = compare(got, want)
            else:
                duck, problem = 0.0, None
            note = f"{got.num_rows} rows{'' if name in ORACLES else ' (rows only)'}"
        except Exception as exc:  # report and go on with the next query
            took, duck, note = time.time() - start, 0.0, ""
            text = str(exc)
            problem = "ERROR " + type(exc).__name__ + " " + text[:900]
            if "-v" in sys.argv:
                traceback.print_exc()
        result[name] = problem
        if verbose:
            empty = " EMPTY" if note.startswith("0 rows") else ""
            print(f"{'ok  ' if problem is None else 'BAD '} {name} {took:.2f}s duck {duck:.2f}s {note}{empty} {problem or ''}", flush=True)
    return result


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from marketloom.session import build_session

    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    folder = args[0]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    out = run(spark, folder, args[1:])
    bad = [k for k, v in out.items() if v]
    print(f"{len(out) - len(bad)} ok, {len(bad)} bad: {bad}")
