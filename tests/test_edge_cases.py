"""Hand-made rows for the edge cases of FIXTURES.md §3 and SURVEY §2.2."""

import datetime as dt

from pyspark.sql import functions as F

from chorus.operators import analytics as an
from chorus.operators import classify as cl
from chorus.operators import commands as cm
from chorus.operators import ingest as ig
from chorus.operators import payload as pl
from chorus.operators import relevance as rv
from chorus.operators import routing as rt
from chorus.schemas import ALERTS, MESSAGE_EVENTS, MESSAGES
from chorus.streaming import monitor as mo

AS_OF = "2024-01-31 00:00:00"
T0 = dt.datetime(2024, 1, 30, 12, 0, 0)


def _msg_rows(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(id=i + 1, message_id=f"m{i + 1}", channel_id="c", channel_name="general",
                    author_id="u1", author_name="ann", content="hello world", timestamp=T0,
                    message_url=f"https://x/{i + 1}", created_at=T0)
        base.update(r)
        full.append(base)
    return spark.createDataFrame(full, MESSAGES)


def _alert_rows(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(id=i + 1, message_id="m1", category="bug", severity="high", summary="s",
                    recommendation="r", timestamp=T0, created_at=T0)
        base.update(r)
        full.append(base)
    return spark.createDataFrame(full, ALERTS)


def _events(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(id=f"e{i}", channel_id="c", channel_name="feedback-lab", author_id="u1",
                    author_name="ann", author_bot=False, guild_name="G", content="a real message",
                    created_ms=1706616000000, url="https://x", attachments=[])
        base.update(r)
        full.append(base)
    return spark.createDataFrame(full, MESSAGE_EVENTS)


def test_relevance_rules(spark):
    df = spark.createDataFrame(
        [("abcd", "1", False), ("abcde", "1", False), ("https://a.b/c \t http://x.y", "1", False),
         ("see https://a.b/c", "1", False), ("hello there", "7", False), ("hello there", "9", False),
         ("hello there", "8", True), ("hello there", "8", None)],
        "content string, author_id string, author_bot boolean")
    kept = rv.relevant_messages(df, team_ids=",7,,9").collect()
    assert sorted(r.content for r in kept) == ["abcde", "hello there", "see https://a.b/c"]


def test_id_list_parsing():
    assert rv.parse_id_list(",7,,9") == ["7", "9"]
    assert rv.parse_id_list(None) == []


def test_event_acceptance_guild_and_channel(spark):
    ev = _events(spark, [
        dict(channel_name="X-Feedback-Lab-2"),
        dict(guild_name=None),
        dict(guild_name="g"),
        dict(channel_name="random"),
        dict(author_bot=True),
    ])
    kept = rv.accept_event(ev, "G", ["feedback-lab"]).collect()
    assert [r.channel_name for r in kept] == ["X-Feedback-Lab-2"]


def test_first_write_wins_and_insert_if_absent(spark):
    ev = _events(spark, [dict(id="a", content="first copy"), dict(id="a", content="second copy"),
                         dict(id="b", content="other message")])
    ev = ev.withColumn("arrival", F.monotonically_increasing_id())
    target = _msg_rows(spark, [dict(message_id="b")])
    out = ig.ingest_messages(ev, target, "G", ["feedback-lab"], as_of=AS_OF, arrival_col="arrival").collect()
    assert [(r.message_id, r.content) for r in out] == [("a", "first copy")]


def test_first_write_wins_with_broker_arrival_order(spark):
    """Kafka-style arrival (broker timestamp, partition, offset): copies in
    different partitions are ordered by time, not by their offsets."""
    ev = _events(spark, [dict(id="a", content="later copy"), dict(id="a", content="earlier copy"),
                         dict(id="c", content="same time, lower offset"), dict(id="c", content="same time, higher")])
    arrival = {"later copy": (T0 + dt.timedelta(seconds=5), 0, 1),
               "earlier copy": (T0, 1, 900),
               "same time, lower offset": (T0, 2, 3),
               "same time, higher": (T0, 2, 4)}
    sarr = spark.createDataFrame([(k, *v) for k, v in arrival.items()],
                                 "content string, ts timestamp, partition int, offset long")
    ev = ev.join(sarr, "content").withColumn("arrival", F.struct("ts", "partition", "offset")) \
        .drop("ts", "partition", "offset")
    out = ig.ingest_messages(ev, None, "G", ["feedback-lab"], as_of=AS_OF, arrival_col="arrival").collect()
    assert sorted((r.message_id, r.content) for r in out) == [("a", "earlier copy"), ("c", "same time, lower offset")]
    assert "arrival" not in out[0].asDict()


def test_parse_analysis_paths(spark):
    rows = [
        ("prose", 'Sure: {"requiresAlert":true,"category":"bug","severity":"high","summary":"x",'
                  '"recommendation":"y"} bye'),
        ("none", "cannot say"),
        ("cut", '{"category":"bu'),
        ("bad", "{bad}"),
        ("quoted", '{"requiresAlert":"false","category":"bug","summary":"q"}'),
        ("single", "{'a':1}"),
        ("trailing", '{"a":1} x {"a":2}'),
        ("dupkeys", '{"a":1,"a":2}'),
        ("zero", '{"requiresAlert":0,"category":"other","summary":"z"}'),
        ("empty", '{"requiresAlert":"","category":"other","summary":"z"}'),
        ("object", '{"requiresAlert":{},"category":"other","summary":"z"}'),
        ("nullv", '{"requiresAlert":null,"category":"other","summary":"z"}'),
    ]
    df = spark.createDataFrame(rows, "k string, response string")
    got = {r.k: r for r in cl.parse_analysis(df).collect()}
    assert got["prose"].parse_status == "ok" and got["prose"].requires_alert and got["prose"].category == "bug"
    assert got["none"].parse_status == "no_json" and got["none"].category == "other"
    assert got["none"].summary == "Analysis inconclusive" and got["none"].recommendation == "Review manually"
    assert got["none"].requires_alert is False
    assert got["cut"].parse_status == "no_json"
    assert got["bad"].parse_status == "bad_json" and got["bad"].requires_alert is False
    assert got["quoted"].requires_alert is True
    assert got["single"].parse_status == "bad_json"
    assert got["trailing"].parse_status == "ok"
    assert got["dupkeys"].parse_status == "bad_json"
    assert got["zero"].requires_alert is False
    assert got["empty"].requires_alert is False
    assert got["object"].requires_alert is True
    assert got["nullv"].requires_alert is False


def test_pluggable_classifier_runs_in_batches(spark):
    import pandas as pd

    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: '{"requiresAlert": true, "category": "bug", "summary": "%d chars"}' % len(t))

    df = spark.createDataFrame([("m1", "abc"), ("m2", "hello")], "message_id string, content string")
    out = {r.message_id: r for r in cl.analyse_messages(df, model).collect()}
    assert out["m2"].summary == "5 chars" and out["m2"].requires_alert


def test_alert_rows_and_routed_tables(spark):
    analysed = spark.createDataFrame(
        [("m1", True, "bug", "", "bug one", "fix", "ok"),
         ("m2", True, "feature_request", None, "feat", "add", "ok"),
         ("m3", True, "praise", None, "nice", "share", "ok"),
         ("m4", False, "other", None, "chat", "none", "ok"),
         ("m5", True, None, None, "x", "y", "ok"),
         ("m6", False, None, None, None, None, "bad_json")],
        "message_id string, requires_alert boolean, category string, severity string, summary string, "
        "recommendation string, parse_status string")
    alerts = rt.alert_rows(analysed, as_of=AS_OF).withColumn("id", F.monotonically_increasing_id())
    rows = {r.message_id: r for r in alerts.collect()}
    assert set(rows) == {"m1", "m2", "m3"}
    assert rows["m1"].severity is None
    bugs = rt.bug_report_rows(alerts).collect()
    assert len(bugs) == 1 and bugs[0].severity == "medium" and bugs[0].subject == "[Discord] bug one"
    assert bugs[0].description == "Original Message ID: m1\nRecommendation: fix"
    assert bugs[0].created_at == 1706659200
    feats = rt.feature_suggestion_rows(alerts).collect()
    assert len(feats) == 1 and feats[0].createdAt == "2024-01-31T00:00:00.000Z"
    q = {r.message_id: r.reason for r in rt.quarantine_rows(analysed).collect()}
    assert q == {"m5": "category_null", "m6": "bad_json"}


def test_monitor_skips_own_entries_and_null_subject(spark):
    bugs = spark.createDataFrame([(1, "[Discord] x"), (2, "external"), (3, None), (4, "later")],
                                 "id long, subject string")
    got = [r.id for r in mo.new_external_entries(bugs, "bug", mark=1).collect()]
    assert got == [2, 3, 4]


def test_search_semantics(spark):
    m = _msg_rows(spark, [dict(content="App CRASH on start"), dict(content="abc and a_c"),
                          dict(content="nothing here")])
    a = _alert_rows(spark, [dict(id=1, message_id="m1", timestamp=T0),
                            dict(id=2, message_id="m2", timestamp=T0 + dt.timedelta(minutes=1)),
                            dict(id=3, message_id="m3", category="praise")])
    assert [r.id for r in an.search_alerts(a, m, "crash").collect()] == [1]
    assert [r.id for r in an.search_alerts(a, m, "a_c").collect()] == [2]
    assert sorted(r.id for r in an.search_alerts(a, m, "", category="").collect()) == [1, 2, 3]
    assert [r.id for r in an.search_alerts(a, m, None, category="praise").collect()] == [3]
    # a bare end date means its midnight: the whole day is excluded
    assert an.search_alerts(a, m, end_date="2024-01-30").count() == 0


def test_recent_alerts_view_hours_zero_and_preview(spark):
    m = _msg_rows(spark, [dict(content="hi")])
    a = _alert_rows(spark, [dict(severity="critical")])
    r = cm.recent_alerts_view(a, m, hours=0, as_of=AS_OF).collect()
    assert r[0].message == "hi..." and r[0].color == 0xFF0000
    empty = cm.recent_alerts_reply(a.limit(0), m, hours=5, as_of=AS_OF).collect()
    assert empty[0].reply == "No alerts found in the last 5 hours."


def test_weekly_report_null_severity_key(spark):
    m = _msg_rows(spark, [dict(author_name="ann"), dict(author_name="ann_v2",
                                                        timestamp=T0 + dt.timedelta(hours=1))])
    a = _alert_rows(spark, [dict(message_id="m1", severity=None), dict(message_id="m2", severity="low")])
    rep = an.weekly_report(a, m, as_of=AS_OF).collect()[0]
    assert rep.total == 2 and rep.bySeverity == {"null": 1, "low": 1}
    assert rep.topContributors[0].author_name == "ann_v2"


def test_trending_prefix_case_and_bound(spark):
    rows = [dict(content="Hello there friends!") for _ in range(3)] + \
           [dict(content="hello there friends!") for _ in range(3)] + \
           [dict(content="only twice here....") for _ in range(2)]
    out = an.trending_prefixes(_msg_rows(spark, rows), as_of=AS_OF).collect()
    assert [(r.keyword, r.frequency) for r in out] == [("hello there friends!", 3)] * 2


def test_sentiment_leading_number(spark):
    df = spark.createDataFrame([("0.8 (positive)",), ("n/a",), ("  .5",), ("1e-1x",)], "t string")
    got = [r.s for r in df.select(cl.parse_float_js(F.col("t")).alias("s")).collect()]
    assert got == [0.8, None, 0.5, 0.1]


def test_backlog_age_equal_to_window_kept(spark):
    m = _msg_rows(spark, [dict(timestamp=dt.datetime(2024, 1, 30, 0, 0, 0)),
                          dict(timestamp=dt.datetime(2024, 1, 29, 23, 59, 59))])
    got = [r.message_id for r in ig.backlog(m, as_of=AS_OF, hours_back=24).collect()]
    assert got == ["m1"]


def test_attachments_payload(spark):
    df = spark.createDataFrame(
        [(1, "bug", "low", "s", None, "txt", "ann", "gen", "",
          [("a.png", "https://f/a", "image/png"), ("b.mp4", "https://f/b", "video/mp4")])],
        "alert_id long, category string, severity string, summary string, recommendation string, "
        "content string, author_name string, channel_name string, message_url string, "
        "attachments array<struct<name:string,url:string,contentType:string>>")
    e = pl.alert_embed_columns(df).collect()[0]
    assert e.image_url == "https://f/a"
    assert e.media_value == "[a.png](https://f/a)\n[b.mp4](https://f/b)"
    assert e.files == ["https://f/a", "https://f/b"]
    assert e.link_value is None and e.recommendation_value == "Review message"
    assert e.title == "🐛 BUG" and e.color == 0x00CC00
    routed = sorted(pl.route_alerts(df).collect(), key=lambda r: r.seq)
    assert [(r.seq, r.target_channel) for r in routed] == [(0, "❗║error-handling"), (1, "❗║error-handling")]
    import json
    embed = json.loads(routed[0].embed_json)
    assert embed["title"] == "🐛 BUG" and embed["image"] == "https://f/a"
    assert [f["name"] for f in embed["fields"]][-1] == "Media Attachments"
    assert routed[0].content is None and routed[0].files == ["https://f/a", "https://f/b"]
    assert routed[1].embed_json is None and routed[1].files == [] and routed[1].content.startswith("✅")


def test_route_drops_missing_channel(spark):
    df = spark.createDataFrame(
        [(1, "feature_request", None, "s", "r", "txt", "ann", "gen", "u"),
         (2, "complaint", "high", "s", "r", "txt", "ann", "gen", "u")],
        "alert_id long, category string, severity string, summary string, recommendation string, "
        "content string, author_name string, channel_name string, message_url string")
    channels = spark.createDataFrame([("❗║ERROR-handling", "text"), ("⚙️║feature-suggestions", "voice")],
                                     "name string, type string")
    got = [(r.source_id, r.seq) for r in pl.route_alerts(df, channels).collect()]
    assert got == [(2, 0)]


def test_feature_entry_time_uses_created_at_text(spark):
    df = spark.createDataFrame([(5, "t", "d", "open", "medium", "2024-01-02T03:04:05.000Z")],
                               "id long, title string, description string, status string, priority string, "
                               "createdAt string")
    e = pl.external_embed_columns(df, "feature").collect()[0]
    assert e.embed_time == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert e.level_value == "MEDIUM" and e.color == 0xFFCC00


def test_resolution_latest_wins(spark):
    a = _alert_rows(spark, [dict(id=1, message_id="m1"), dict(id=2, message_id="m1"), dict(id=3, message_id="m2")])
    res = spark.createDataFrame([("m1", "old", T0), ("m1", "new", T0 + dt.timedelta(days=1))],
                                "message_id string, note string, resolved_at timestamp")
    out = {r.id: r for r in rt.resolve_alerts(a, res).collect()}
    assert out[1].resolved and out[2].resolution_note == "new" and out[3].resolved is None


def test_templates(spark):
    a = _alert_rows(spark, [dict(id=1, severity="low"), dict(id=2, severity=None), dict(id=3, severity="critical"),
                            dict(id=4, category="praise", severity=None)])
    assert [r.id for r in rt.apply_template(a, "BUG_TRACKING").collect()] == [3]
    assert [(r.id, r.target_channel) for r in rt.apply_template(a, "PRODUCT_FEEDBACK").collect()] == [(4, "wins")]


def test_channel_stats_fan_out(spark):
    m = _msg_rows(spark, [dict(), dict(author_id="u2")])
    a = _alert_rows(spark, [dict(id=1, message_id="m1"), dict(id=2, message_id="m1")])
    r = an.channel_stats(m, a).collect()[0]
    assert (r.message_count, r.unique_authors, r.alert_count) == (3, 2, 2)
    r = an.channel_stats(m, a, distinct_messages=True).collect()[0]
    assert r.message_count == 2


def test_lookback_rejects_negative(spark):
    import pytest

    from chorus.functions.columns import lookback
    with pytest.raises(ValueError):
        lookback(F.col("timestamp"), AS_OF, hours=-1)


def test_links_only_forms_agree(spark):
    """Anchored form == remove-then-trim form, on random URL/space/text mixes."""
    import random
    rnd = random.Random(7)
    parts = ["https://a.b/c", "http://x", "http://", "https:/", "xhttps://a", " ", "\t", "\n", " ",
             " ", "word", "h", "ttp://", "https://ahttp://b", ""]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    out = df.select(rv.links_only(F.col("content")).alias("a"),
                    rv.links_only_by_removal(F.col("content")).alias("b")).collect()
    assert all(r.a == r.b for r in out)


def test_native_sentiment_text_round_trip(spark):
    """The native scorer's text answer parses back to its score."""
    df = spark.createDataFrame([("great, thanks!",), ("awful and useless",), ("plain",)], "content string")
    out = df.select(cl.keyword_sentiment(F.col("content")).alias("s"),
                    cl.parse_float_js(cl.keyword_sentiment_response(F.col("content"))).alias("p")).collect()
    assert all(r.s == r.p for r in out)
    assert [r.s for r in out] == [0.75, 0.25, 0.5]


def test_constraint_checks_find_violations(spark):
    from chorus.operators import quality as qa
    m = _msg_rows(spark, [dict(message_id="m1"), dict(message_id="m1"), dict(message_id="m2")])
    a = _alert_rows(spark, [dict(id=1, message_id="m1", category="bogus"), dict(id=2, message_id="zz"),
                            dict(id=3, message_id="m2", severity="urgent")])
    got = {(r.table, r.rule): r.violations for r in qa.validate(m, a).collect()}
    assert got[("messages", "unique:message_id")] == 1
    assert got[("alerts", "foreign_key:message_id")] == 1
    assert got[("alerts", "domain:category")] == 1
    assert got[("alerts", "domain:severity")] == 1
    assert got[("messages", "not_null:content")] == 0
    keys = {(r.rule, r.key) for r in qa.violations(m, a).collect()}
    assert ("foreign_key:message_id", "2") in keys and ("unique:message_id", "m1") in keys


def test_orphan_count_is_per_alert_row_with_hot_key(spark):
    """The FK count is pre-aggregated per message; it still counts alert rows."""
    from chorus.operators import quality as qa
    m = _msg_rows(spark, [dict(message_id="m1")])
    a = _alert_rows(spark, [dict(id=i, message_id="gone") for i in range(1, 51)]
                    + [dict(id=100, message_id="other"), dict(id=101, message_id="m1")])
    got = {(r.table, r.rule): r.violations for r in qa.validate(m, a).collect()}
    assert got[("alerts", "foreign_key:message_id")] == 51
    none = {(r.table, r.rule): r.violations for r in qa.validate(m, a.filter(F.col("id") == 101)).collect()}
    assert none[("alerts", "foreign_key:message_id")] == 0


def test_constraint_counts_with_null_keys(spark):
    """NULL keys: never a match for the foreign key, one group for UNIQUE."""
    from chorus.operators import quality as qa
    m = spark.createDataFrame([("m1", "x"), (None, "y"), (None, "z")], "message_id string, content string")
    a = spark.createDataFrame([(1, "m1", "bug", None), (2, None, "bug", "low"), (3, "zz", "bogus", None)],
                              "id long, message_id string, category string, severity string")
    got = {(r.table, r.rule): r.violations for r in qa.validate(m, a).collect()}
    assert got == {("messages", "not_null:message_id"): 2, ("messages", "not_null:content"): 0,
                   ("messages", "unique:message_id"): 1, ("alerts", "not_null:id"): 0,
                   ("alerts", "not_null:message_id"): 1, ("alerts", "not_null:category"): 0,
                   ("alerts", "domain:category"): 1, ("alerts", "domain:severity"): 0,
                   ("alerts", "foreign_key:message_id"): 2}


def test_team_metrics_one_hour_boundary_in_whole_seconds(spark):
    """Young = less than 3600 whole seconds before as_of; a future alert counts as young."""
    m = _msg_rows(spark, [dict(message_id="m1", author_id="u1"), dict(message_id="m2", author_id="u2")])
    a = _alert_rows(spark, [
        dict(id=1, message_id="m1", timestamp=dt.datetime(2024, 1, 30, 23, 0, 0)),   # 3600 s: not young
        dict(id=2, message_id="m1", timestamp=dt.datetime(2024, 1, 30, 23, 0, 1)),   # 3599 s: young
        dict(id=3, message_id="m2", timestamp=dt.datetime(2024, 1, 31, 0, 10, 0)),   # future: young
        dict(id=4, message_id="m2", timestamp=dt.datetime(2024, 1, 21, 0, 0, 0)),    # in window, old
        dict(id=5, message_id="m2", timestamp=dt.datetime(2023, 12, 1, 0, 0, 0)),    # outside 30 days
    ])
    (r,) = an.team_metrics(a, m, days=30, as_of=AS_OF).collect()
    assert (r.category, r.alerts_created, r.unique_reporters) == ("bug", 4, 2)
    assert isinstance(r.response_within_1hr, float) and r.response_within_1hr == 0.5


def test_daily_report_channels_sorted_distinct(spark):
    m = _msg_rows(spark, [dict(message_id="m1", channel_name="b"), dict(message_id="m2", channel_name="a"),
                          dict(message_id="m3", channel_name="b")])
    a = _alert_rows(spark, [dict(id=i, message_id=f"m{i}") for i in (1, 2, 3)])
    (r,) = an.daily_report(a, m, as_of=AS_OF).collect()
    assert (r.category, r["count"], r.channels) == ("bug", 3, "a,b")


def test_utc_day_boundary_reproduces_text_comparison(spark):
    m = _msg_rows(spark, [dict(timestamp=dt.datetime(2024, 1, 30, 0, 0, 1)),
                          dict(timestamp=dt.datetime(2024, 1, 29, 23, 59, 59))])
    a = _alert_rows(spark, [dict(id=1, message_id="m1", timestamp=dt.datetime(2024, 1, 30, 0, 0, 1)),
                            dict(id=2, message_id="m2", timestamp=dt.datetime(2024, 1, 30, 0, 0, 0))])
    as_of = "2024-01-31 06:00:00"
    # instant: strictly newer than 2024-01-30 06:00 → none; utc_day: same UTC date as the cutoff → both
    assert an.recent_alerts(a, m, 24, as_of=as_of).count() == 0
    assert an.recent_alerts(a, m, 24, as_of=as_of, boundary="utc_day").count() == 2


def test_log_preview(spark):
    from chorus.functions.columns import log_preview
    df = spark.createDataFrame([("hi",), ("x" * 101,), ("y" * 100,)], "c string")
    got = [r.p for r in df.select(log_preview(F.col("c")).alias("p")).collect()]
    assert got == ["hi", "x" * 100 + "...", "y" * 100]
