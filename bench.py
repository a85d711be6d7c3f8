"""Benchmark the registered queries.

Runs every query of the feedback catalog (``chorus.plans.catalog``) over ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` (default 8) and
prints ONE JSON line:

    {"metric": "total_query_seconds", "value": N, "unit": "sec",
     "queries": {"q01_recent_alerts": sec, ...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (every row is
computed, nothing is collected to the driver). The value per query is
the median of ``$BENCH_REPEAT`` runs (default 1) after warm-up runs of three
representative queries (JVM start, JIT, first scans).

The headline ``value`` covers the registered queries end to end: each one
derives ``messages`` / ``alerts`` from the given parquet and then runs its
operator. A deployment keeps those two tables stored (partitioned by date);
unless ``BENCH_STORED=0``, the tables are also written once under the
session's checkpoint folder and the operators that read only them are timed
again over the stored tables (``stored_queries``, ``store_write_sec``).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


# Registered queries that read only the messages / alerts tables.
STORED_PREFIXES = ("q01", "q02", "q03", "q04", "q05", "q06", "q07", "q08", "q09", "q12_classify",
                   "q13_store", "q14", "q15", "q18", "q19", "q20", "q21", "q22", "q23", "q24", "q26", "q27")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]

    from chorus.session import get_session
    spark = get_session("chorus-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)

    from chorus.plans import catalog
    queries = dict(catalog.QUERIES)
    names = [n for n in sorted(queries) if not only or any(o in n for o in only)]

    # warm-up: JVM, JIT, parquet footers; a join report, a text-heavy and a
    # streaming-ingest query cover the code paths the timed runs take
    warm = [n for n in ("q01_recent_alerts", "q12_classify_messages", "q11_ingest_messages") if n in queries]
    for n in (warm or names[:1]):
        queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)

    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
              "unit": "sec", "queries": times}

    if os.environ.get("BENCH_STORED", "1") != "0":
        from chorus.plans import catalog
        from chorus.session import ensure_checkpoint_dir
        from chorus.sources import stored
        root = os.path.join(ensure_checkpoint_dir(spark), f"bench-store-{uuid.uuid4().hex[:8]}")
        t0 = time.perf_counter()
        stored.write_feedback_tables(spark, sf_dir, root)
        result["store_write_sec"] = round(time.perf_counter() - t0, 3)
        catalog.STORE_ROOT = root
        try:
            st_times = {}
            for name in names:
                if not name.startswith(STORED_PREFIXES):
                    continue
                t0 = time.perf_counter()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                st_times[name] = round(time.perf_counter() - t0, 3)
        finally:
            catalog.STORE_ROOT = None
        result["stored_queries"] = st_times
        result["stored_total_sec"] = round(sum(st_times.values()), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    result.update({"sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "n_queries": len(times)})
    print(json.dumps(result))


if __name__ == "__main__":
    main()
