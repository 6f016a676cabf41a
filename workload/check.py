"""Compare the registered queries with their SQL: python -m workload.check [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from workload.oracle import oracle_sql  # noqa: E402
from workload.queries import queries  # noqa: E402


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=key)
    result = con.sql(sql)
    if sorted(result.columns) != names:
        return f"columns {names} / {sorted(result.columns)}"
    at = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        for n, x, y in zip(names, a, b):
            if not same(x, y):
                return f"{n}: {x!r} / {y!r} in {a} / {b}"
    return None


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def main(argv: list[str]) -> int:
    from bench import session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    statements, bad = oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            found = compare(df, con, statements[name]) if name in statements else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
            if len(argv) > 1:
                traceback.print_exc()
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
