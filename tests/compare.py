"""Side-by-side run of a registered query and its DuckDB SQL.

``python -m tests.compare sf0.01 name1 name2 ...`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

ROOT = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [[_norm(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*cols, strict=True), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    got = fn(spark, sf_dir).toArrow()
    seconds = time.time() - t0
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} vs {sorted(want.column_names)}", seconds
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", seconds
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    types = {n: (str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in got.column_names}
    odd = {n: t for n, t in types.items() if (("int" in t[0]) != ("int" in t[1])) or (("double" in t[0]) != ("double" in t[1]))}
    if bad:
        return f"{len(bad)} of {len(a)} differ ({sorted(got.column_names)}): {bad[0]}", seconds
    if odd:
        return f"types {odd}", seconds
    return None if a else "empty", seconds


def main() -> None:
    from fareflow.catalog import all_oracles, all_queries
    from fareflow.session import local_session
    sf_dir = f"{ROOT}/{sys.argv[1]}"
    spark, con = local_session(8), duck(sf_dir)
    oracles, bad = all_oracles(), 0
    for name, fn in all_queries().items():
        if sys.argv[2:] and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in sys.argv[2:]):
            continue
        try:
            if name in oracles:
                problem, seconds = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                t0 = time.time()
                n = fn(spark, sf_dir).count()
                problem, seconds = (None if n else "empty"), time.time() - t0
        except Exception as e:  # noqa: BLE001
            problem, seconds = f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {seconds:6.2f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
