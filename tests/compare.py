"""Run registered queries against their DuckDB SQL.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str, clock: list | None = None) -> list[str]:
    """Differences between the two results; empty when they are the same."""
    clock = [] if clock is None else clock
    clock.append(time.time())
    frame = query(spark, sf_dir)
    got_names = frame.columns
    got = _rows(got_names, frame.collect())
    clock.append(time.time())
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = _rows(want_names, cursor.fetchall())
    clock.append(time.time())
    problems = []
    if sorted(got_names) != sorted(want_names):
        problems.append(f"columns {sorted(got_names)} != {sorted(want_names)}")
    if sum(got.values()) != sum(want.values()):
        problems.append(f"rows {sum(got.values())} != {sum(want.values())}")
    extra, missing = got - want, want - got
    if extra or missing:
        problems.append(
            f"{sum(extra.values())} rows differ\n  columns {sorted(got_names)}"
            + "".join(f"\n  spark  {r}" for r in sorted(extra, key=str)[:3])
            + "".join(f"\n  duckdb {r}" for r in sorted(missing, key=str)[:3])
        )
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    unknown = set(sqls) - set(queries)
    if unknown:
        print("SQL without a query:", unknown)
    for name in wanted or queries:
        started = time.time()
        if name not in sqls:
            n = queries[name](spark, sf_dir).count()
            print(f"{name:28s} rows only: {n}  {time.time() - started:.1f}s", flush=True)
            continue
        clock = []
        try:
            problems = compare(spark, con, sf_dir, queries[name], sqls[name], clock)
        except Exception as error:  # keep going, report at the end of the line
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        verdict = "ok" if not problems else "DIFFERENT " + "; ".join(problems)
        parts = " ".join(f"{b - a:.1f}s" for a, b in zip(clock, clock[1:]))
        print(f"{name:28s} {verdict}  spark/duckdb {parts}", flush=True)


if __name__ == "__main__":
    main()
