"""Joins of alerts with their messages carry keys; texts come last and once."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chorus.operators import analytics as an
from chorus.operators import ingest as ig
from chorus.operators.joins import join_messages
from chorus.plans import catalog, payload_catalog
from chorus.sources import derived as dv

SF = "/root/testdata/sf0.001"
ALL = {**catalog.QUERIES, **payload_catalog.QUERIES}


def exchanges(df):
    """(keys, columns with their types) of every shuffle of the plan."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.initialPlan()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out = node.output()
            found.append((node.outputPartitioning().toString(), " ".join(f"{out.apply(i).name()} {out.apply(i).dataType().simpleString()}" for i in range(out.size()))))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", ["q01_recent_alerts", "q01_recent_alerts_7d", "q05_search_alerts", "q19_search_view", "q22_support_tickets", "q14_route_with_channels",
                                  "q15_alert_embeds", "q15_alert_payloads", "q26_issue_documents", "q26_issue_payloads", "q11_ingest_messages"])
def test_no_text_is_dealt_by_message(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        by_message = [columns for keys, columns in exchanges(ALL[name](spark, SF)) if "message_id" in keys]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert by_message
    for columns in by_message:
        assert not any(word in columns for word in ("content", "summary", "text ", "line "))


@pytest.fixture()
def odd(tmp_path):
    """Documents with repeated ids, equal and different texts, null texts, and ids that no event meets."""
    docs = [(0, "The first\nline", "src1"), (0, "The other", "src3"), (1, None, "src3"), (2, "same", "src1"), (2, "same", "src1"), (3, "", "src3"), (40, "far", "src1"), (5, "The ß text", "src13")]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": [d[2] for d in docs]}), tmp_path / "documents.parquet")
    events = pq.read_table(f"{SF}/events.parquet").slice(0, 400)
    pq.write_table(events, tmp_path / "events.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_linked_tables_join_to_the_same_rows(spark, odd):
    a, m = dv.alerts(spark, odd), dv.messages(spark, odd)
    la, lm, texts = dv.linked_alerts(spark, odd), dv.linked_messages(spark, odd), dv.alert_texts(spark, odd)
    columns = ["content", "author_name", "author_id", "channel_name", "channel_id", "message_url"]
    whole = join_messages(a, m, columns)
    assert whole.count() > a.count() and rows(join_messages(la, lm, columns, texts=texts)) == rows(whole)
    week = dict(hours=24 * 30, as_of=dv.AS_OF)
    assert rows(an.recent_alerts(la, lm, texts=texts, **week)) == rows(an.recent_alerts(a, m, **week))
    for wanted in (dict(query="the"), dict(query="%", channel="src3"), dict(category="bug", channel="src1")):
        assert rows(an.search_alerts(la, lm, limit=None, texts=texts, **wanted)) == rows(an.search_alerts(a, m, limit=None, **wanted))


def test_ingest_by_links_gives_each_row_one_text(spark, odd):
    out = catalog.QUERIES["q11_ingest_messages"](spark, odd)
    raw = dv.raw_message_rows(spark, odd)
    first = dv.events_from_rows(raw).withColumn("arrival", F.lit(0))
    again = dv.events_from_rows(raw.filter("event_type = 'signup'")).withColumn("content", F.upper("content")).withColumn("arrival", F.lit(1))
    stored = dv.messages(spark, odd).filter(F.col("timestamp") < F.lit(catalog.INGEST_CUTOFF).cast("timestamp"))
    want = ig.ingest_messages(first.unionByName(again), stored, catalog.SERVER, catalog.MONITORED, catalog.TEAM, as_of=dv.AS_OF, arrival_col="arrival")
    # which of an id's documents stands is open where they arrive together
    ids = lambda df: sorted(r["message_id"] for r in df.collect())
    assert ids(out) == ids(want) and len(set(ids(out))) == len(ids(out))
    assert all(r["content"] in {"The first\nline", "The other", "The ß text", "same"} for r in out.collect())
