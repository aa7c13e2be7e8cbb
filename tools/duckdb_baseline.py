"""Time every oracle SQL statement on DuckDB (single node) at one scale: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tools.oracle_check import TABLES  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    threads = int(os.environ.get("BENCH_CPUS", "8"))
    from voltframe.plans.oracle import SQL

    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    times = {}
    for name, sql in SQL.items():
        t0 = time.perf_counter()
        con.execute(f"SELECT count(*) FROM ({sql})").fetchall()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "threads": threads, "total": round(sum(times.values()), 3),
                      "queries": times}))


if __name__ == "__main__":
    main()
