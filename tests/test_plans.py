"""Plan shape of the derived tables, and scan reuse per file version."""

import os

from pyspark.sql import functions as F

from chorus.operators import analytics as an
from chorus.sources import derived as dv
from chorus.sources.tables import read_table

SF = "/root/testdata/sf0.001"
AS_OF = dv.AS_OF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scan_lines(plan: str, table: str) -> list[str]:
    return [ln for ln in plan.splitlines() if "FileScan parquet" in ln and f"{table}.parquet" in ln]


def test_alert_lookback_reaches_event_scan(spark):
    # The look-back on the alerts' timestamp is evaluated at the events scan
    # (pushed through the union of the two alert kinds and the projection),
    # so only the matching events reach the join with the documents.
    df = an.hot_topics(dv.alerts(spark, SF), hours=24, as_of=AS_OF)
    scans = _scan_lines(_plan(df), "events")
    assert scans, "no events scan in the plan"
    assert all("ts#" in ln.split("DataFilters:")[1].split("Format:")[0] for ln in scans), scans


def test_alert_summary_is_the_whole_message_on_one_line(spark):
    a, m = dv.alerts(spark, SF), dv.messages(spark, SF)
    joined = a.join(m, "message_id").select("summary", F.translate("content", "\n", " ").alias("line"))
    assert joined.filter("summary <> line").count() == 0
    assert joined.agg(F.max(F.length("summary"))).first()[0] > 500


def test_message_scan_prunes_text_when_unused(spark):
    plan = _plan(dv.messages(spark, SF).groupBy("channel_name").count())
    docs = _scan_lines(plan, "documents")
    assert docs and all("text" not in ln.split("ReadSchema:")[1] for ln in docs), docs


def _write_single_file(path, n):
    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": ["t"] * n}), path)


def test_scan_and_count_reused_per_file_version(spark, scratch):
    d = os.path.join(scratch, "sf")
    os.makedirs(d)
    path = os.path.join(d, "documents.parquet")
    _write_single_file(path, 5)
    a = read_table(spark, d, "documents")
    assert read_table(spark, d, "documents") is a
    n = dv._document_count(a)
    assert spark.range(1).select(n.alias("n")).first()["n"] == 5

    # A new version of the file gets a new scan and a new count.
    _write_single_file(path, 7)
    os.utime(path, (1, 1))  # another modification time even within the same millisecond
    b = read_table(spark, d, "documents")
    assert b is not a
    assert b.count() == 7
    n2 = dv._document_count(b)
    assert spark.range(1).select(n2.alias("n")).first()["n"] == 7


def test_directory_tables_are_never_reused(spark, scratch):
    # A folder's modification time does not change when a file lands in an
    # existing sub-folder: folder tables are listed afresh on every read.
    d = os.path.join(scratch, "sf")
    path = os.path.join(d, "documents.parquet")
    spark.range(3).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("p")) \
        .write.partitionBy("p").parquet(path)
    a = read_table(spark, d, "documents")
    spark.range(4).select(F.col("id").alias("doc_id"), F.lit("u").alias("text")) \
        .write.mode("append").parquet(os.path.join(path, "p=1"))
    b = read_table(spark, d, "documents")
    assert b is not a
    assert b.count() == 7


def test_stored_date_bounds_prune_alert_partitions(spark, scratch):
    # Over tables stored by UTC date, the search's date range (Q5) and the
    # duplicate candidates' look-back (Q8) also bound the dt partition.
    from chorus.plans import catalog
    from chorus.plans import catalog
    from chorus.sources import stored
    stored.write_feedback_tables(spark, SF, os.path.join(scratch, "store"))
    catalog.STORE_ROOT = os.path.join(scratch, "store")
    try:
        for name in ("q05_search_alerts_filters", "q08_duplicate_bugs"):
            df = catalog.QUERIES[name](spark, SF)
            scans = [ln for ln in _plan(df).splitlines()
                     if "FileScan parquet" in ln and "/store/alerts" in ln]
            assert scans, name
            assert all("dt#" in ln.split("PartitionFilters:")[1].split("PushedFilters:")[0]
                       for ln in scans), (name, scans)
    finally:
        catalog.STORE_ROOT = None


def test_no_query_plans_pairs_or_python(spark):
    # Scale guards over every registered query: no cartesian product or
    # nested-loop join (all pairs), and no Python stage on the default path
    # (the native keyword model; Python runs only for a user-supplied model).
    from chorus.plans import catalog
    banned = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
              "MapInPandas")
    for name, fn in sorted(catalog.QUERIES.items()):
        plan = _plan(fn(spark, SF))
        assert not [b for b in banned if b in plan], name


def _write_inputs(d, n_events, event_type="error"):
    import datetime as dt

    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({
        "event_id": list(range(n_events)),
        "ts": [dt.datetime(2024, 1, 30, 12, 0, 0)] * n_events,
        "user_id": [1] * n_events,
        "event_type": [event_type] * n_events,
        "value": [0.0] * n_events,
        "props": [""] * n_events,
    }), os.path.join(d, "events.parquet"))
    pq.write_table(pa.table({"doc_id": [0, 1], "text": ["a crash here", "all fine"], "lang": ["en"] * 2,
                             "source": ["s1", "s2"], "n_chars": [12, 8]}), os.path.join(d, "documents.parquet"))


def test_derived_definitions_follow_input_versions(spark, scratch):
    # Derived tables are shared per input file version; a new version of an
    # input gets a new definition (never a stale one).
    d = os.path.join(scratch, "inputs")
    os.makedirs(d)
    _write_inputs(d, 4)
    a = dv.alerts(spark, d)
    assert dv.alerts(spark, d) is a
    assert a.count() == 4 + 1  # event 0 also gets the second alert (id % 10 = 0)
    _write_inputs(d, 12, event_type="view")
    os.utime(os.path.join(d, "events.parquet"), (1, 1))
    b = dv.alerts(spark, d)
    assert b is not a
    assert b.count() == 12 + 2  # events 0 and 10
    assert {r.category for r in b.select("category").collect()} == {"complaint"}
