"""Time the oracle SQL of every registered query in DuckDB (single node).

The reference publishes no benchmark; DuckDB running the same statements
on the same parquet is the single-node point of comparison for bench.py.
Prints one JSON line like bench.py.
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chorus.plans.catalog import ORACLES  # noqa: E402
from chorus.sources.tables import TEST_TABLES, table_path  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    threads = int(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    con.execute(f"SET threads={threads}")
    con.execute("SET TimeZone='UTC'")
    for t in TEST_TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    times = {}
    for name in sorted(ORACLES):
        t0 = time.perf_counter()
        con.execute(ORACLES[name]).fetchall()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "duckdb_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf_dir": sf_dir, "threads": threads}))


if __name__ == "__main__":
    main()
