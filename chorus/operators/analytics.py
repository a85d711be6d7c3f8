"""Analytic reports over the ``messages`` and ``alerts`` tables (Q1-Q7, Q9).

Scale notes (messages and alerts both large, partitioned by date):

* Look-back predicates are plain comparisons on the timestamp column, so
  they reach the parquet scan as pushed filters (and prune ``dt``
  partitions when the stored table is partitioned by date).
* Joins are equi-joins on ``message_id``. Spark picks sort-merge or, when
  AQE measures one side under the broadcast threshold, a broadcast join;
  nothing is broadcast by hint here because neither side has a size bound.
* Where alerts only contribute counts (Q4, Q6 contributors, Q9), alerts
  are aggregated per ``message_id`` *before* the join. That keeps the join
  many-to-one, computes the reference's join fan-out arithmetically, and
  collapses a hot message (one key with a third of all alerts) map-side
  instead of sending all its rows to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions.columns import as_of_col, contains_ci, lookback
from chorus.operators.joins import DATE_LINK, LinkedTexts, alert_keys, join_messages, message_dates_since

ALERT_COLUMNS = ["id", "message_id", "category", "severity", "summary", "recommendation",
                 "timestamp", "created_at"]
PARTITION_COLUMNS = ["dt", "epoch", DATE_LINK]


def _alert_cols(alerts: DataFrame, texts: LinkedTexts | None = None) -> list[str]:
    have = [*alerts.columns, *(texts.of_alerts if texts else ())]
    return [c for c in ALERT_COLUMNS if c in have] + \
        [c for c in alerts.columns if c not in ALERT_COLUMNS and c not in PARTITION_COLUMNS]


def recent(df: DataFrame, as_of=None, hours: float | None = None, days: int | None = None,
           boundary: str = "instant", ts_col: str = "timestamp") -> DataFrame:
    """``ts > as_of - window``; on a table stored with a ``dt`` (UTC date)
    partition column the implied ``dt >= date(cutoff)`` is added, so whole
    date folders are pruned before any file is opened."""
    out = df.filter(lookback(F.col(ts_col), as_of, hours=hours, days=days, boundary=boundary))
    if "dt" in df.columns:
        now = as_of_col(as_of)
        span = (F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))
                if hours is not None else F.make_dt_interval(F.lit(int(days))))
        out = out.filter(F.col("dt") >= F.to_date(now - span))
    return out


def recent_alerts(alerts: DataFrame, messages: DataFrame, hours: float = 24, as_of=None,
                  boundary: str = "instant", texts: LinkedTexts | None = None) -> DataFrame:
    """Q1: alerts newer than ``as_of - hours`` with author, content and URL,
    newest first (ties: id desc). No limit."""
    a = recent(alerts, as_of, hours=hours, boundary=boundary)
    return (join_messages(a, messages, ["author_name", "content", "message_url"], texts=texts)
            .select(*_alert_cols(alerts, texts), "author_name", "content", "message_url")
            .orderBy(F.col("timestamp").desc(), F.col("id").desc()))


def newest_alerts(alerts: DataFrame, messages: DataFrame, limit: int, hours: float = 24, as_of=None) -> DataFrame:
    """The first ``limit`` rows of :func:`recent_alerts`, found by keys and times: summaries
    and messages are read for those rows only.

    The chosen rows are at most ``limit``, so they are broadcast to the two lookups."""
    a = recent(alerts, as_of, hours=hours)
    keys = alert_keys(alerts)
    found = join_messages(a.select("id", "timestamp", *keys), messages, []).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)
    chosen = F.broadcast(found.select("id", *keys))
    rows = a.join(chosen.select("id"), "id", "left_semi")
    links = {DATE_LINK: "dt"} if DATE_LINK in keys and "dt" in messages.columns else {}
    m = messages.join(chosen.select("message_id", *[F.col(k).alias(c) for k, c in links.items()]).distinct(), ["message_id", *links.values()], "left_semi")
    return (join_messages(rows, m, ["author_name", "content", "message_url"])
            .select(*_alert_cols(alerts), "author_name", "content", "message_url")
            .orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit))


def daily_report(alerts: DataFrame, messages: DataFrame, as_of=None,
                 boundary: str = "instant") -> DataFrame:
    """Q2: per UTC date and category over the last day: alert count and the
    distinct channel names, sorted and joined by ','.

    The reference reads ``channel_name`` from alerts, which has none; the
    intent is the message's channel, so alerts are joined to messages.
    """
    a = recent(alerts, as_of, days=1, boundary=boundary).select(*alert_keys(alerts), "category", "timestamp")
    return (join_messages(a, messages, ["channel_name"])
            .groupBy(F.to_date("timestamp").alias("date"), F.col("category"))
            .agg(F.count(F.lit(1)).alias("count"),
                 F.expr("listagg(DISTINCT channel_name, ',') WITHIN GROUP (ORDER BY channel_name)")
                 .alias("channels"))
            .orderBy(F.col("date").desc(), F.col("count").desc(), F.col("category")))


def hot_topics(alerts: DataFrame, hours: float = 24, as_of=None, boundary: str = "instant") -> DataFrame:
    """Q3: alert count and mean summary length per (category, severity) over
    the last ``hours``; a NULL severity is its own group."""
    return (recent(alerts, as_of, hours=hours, boundary=boundary)
            .groupBy("category", "severity")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.avg(F.length("summary")).alias("avg_summary_length"))
            .orderBy(F.col("count").desc(), F.col("category"), F.col("severity")))


def channel_stats(messages: DataFrame, alerts: DataFrame, distinct_messages: bool = False) -> DataFrame:
    """Q4: per channel, messages LEFT JOIN alerts: joined row count, distinct
    authors and alert count.

    ``message_count`` keeps the reference's fan-out (a message with two
    alerts counts twice); ``distinct_messages=True`` counts messages once.
    Alerts are pre-aggregated per message, so the join is many-to-one.
    """
    per_msg = alerts.groupBy("message_id").agg(F.count("id").alias("n_alerts"))
    m = messages.select("message_id", "channel_name", "author_id")
    j = m.join(per_msg, "message_id", "left")
    n = F.coalesce(F.col("n_alerts"), F.lit(0))
    msg_count = F.count(F.lit(1)) if distinct_messages else F.sum(F.greatest(n, F.lit(1)))
    return (j.groupBy("channel_name")
            .agg(msg_count.cast("long").alias("message_count"),
                 F.countDistinct("author_id").alias("unique_authors"),
                 F.sum(n).cast("long").alias("alert_count"))
            .orderBy(F.col("message_count").desc(), F.col("channel_name")))


def search_alerts(alerts: DataFrame, messages: DataFrame, query: str | None = None,
                  category: str | None = None, severity: str | None = None,
                  channel: str | None = None, start_date=None, end_date=None,
                  limit: int | None = 100, texts: LinkedTexts | None = None) -> DataFrame:
    """Q5: alerts joined to their message, filtered by the truthy arguments
    (``''``/None = no filter), newest first (ties id desc), top ``limit``.

    ``query`` matches content or summary with SQLite LIKE semantics:
    ASCII case ignored, ``%``/``_`` stay wildcards, no escape character.
    Date bounds are inclusive; a bare end date means its midnight.
    """
    a = alerts
    if category:
        a = a.filter(F.col("category") == category)
    if severity:
        a = a.filter(F.col("severity") == severity)
    # On a table stored by UTC date, each bound also bounds the date
    # partition (dt = to_date(timestamp)), so folders outside are skipped.
    stored = "dt" in alerts.columns
    if start_date:
        lo = F.to_timestamp(F.lit(str(start_date)))
        a = a.filter(F.col("timestamp") >= lo)
        if stored:
            a = a.filter(F.col("dt") >= F.to_date(lo))
    if end_date:
        hi = F.to_timestamp(F.lit(str(end_date)))
        a = a.filter(F.col("timestamp") <= hi)
        if stored:
            a = a.filter(F.col("dt") <= F.to_date(hi))
    m = messages
    in_channel = F.col("channel_name") == channel
    if channel and "channel_name" in m.columns:
        m = m.filter(in_channel)
    j = join_messages(a, m, ["author_name", "content", "channel_name"], texts=texts)
    if channel and "channel_name" not in m.columns:
        j = j.filter(in_channel)
    if query:
        j = j.filter(contains_ci(F.col("content"), query) | contains_ci(F.col("summary"), query))
    out = (j.select(*_alert_cols(alerts, texts), "author_name", "content", "channel_name")
           .orderBy(F.col("timestamp").desc(), F.col("id").desc()))
    return out.limit(limit) if limit else out


def weekly_report_rows(alerts: DataFrame, messages: DataFrame, as_of=None, days: int = 7,
                       top_n: int = 5) -> DataFrame:
    """Q6 in flat form: one row per report entry.

    ``section`` is ``total``, ``category``, ``severity`` (one GROUPING SETS
    pass over alerts) or ``contributor`` (top ``top_n`` authors by alert
    rows on their messages of the period; ties author_id asc). A NULL
    severity key reads ``null`` as JavaScript's ``Object.fromEntries`` does.
    The contributor's name is the one on their latest message.
    """
    a = recent(alerts, as_of, days=days)
    grouped = (a.groupingSets([[], ["category"], ["severity"]], "category", "severity")
               .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid")))
    # gid: 3 = (), 1 = (category), 2 = (severity)
    parts = grouped.select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "category")
        .otherwise("severity").alias("section"),
        F.when(F.col("gid") == 1, F.col("category"))
        .when(F.col("gid") == 2, F.coalesce(F.col("severity"), F.lit("null"))).alias("key"),
        F.lit(None).cast("string").alias("author_name"),
        F.col("count").cast("long").alias("count"),
        F.lit(None).cast("int").alias("rank"))
    since = as_of_col(as_of) - F.make_dt_interval(F.lit(int(days)))
    per_msg = message_dates_since(alerts, since).groupBy(*alert_keys(alerts)) \
        .agg(F.count(F.lit(1)).alias("n"))
    m = recent(messages, as_of, days=days)
    contrib = (join_messages(per_msg, m, ["author_id", "author_name", "timestamp", "id"])
               .groupBy("author_id")
               .agg(F.sum("n").cast("long").alias("count"),
                    F.max_by("author_name", F.struct("timestamp", "id")).alias("author_name")))
    top = (contrib.orderBy(F.col("count").desc(), F.col("author_id")).limit(top_n)
           .withColumn("rank", F.row_number().over(
               Window.orderBy(F.col("count").desc(), F.col("author_id"))))
           .select(F.lit("contributor").alias("section"), F.col("author_id").alias("key"),
                   "author_name", "count", F.col("rank").cast("int").alias("rank")))
    return parts.unionByName(top)


def weekly_report(alerts: DataFrame, messages: DataFrame, as_of=None, days: int = 7,
                  top_n: int = 5) -> DataFrame:
    """Q6 as one row: total, byCategory map, bySeverity map, topContributors.

    The rows being folded are bounded (categories, severities, ``top_n``),
    so the single-row aggregation never gathers an unbounded group.
    """
    rows = weekly_report_rows(alerts, messages, as_of, days, top_n)
    entry = F.struct(F.col("key"), F.col("count"))
    contributor = F.struct(F.col("rank"), F.col("key").alias("author_id"),
                           F.col("author_name"), F.col("count"))
    return rows.agg(
        F.coalesce(F.max(F.when(F.col("section") == "total", F.col("count"))), F.lit(0)).alias("total"),
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("section") == "category", entry)),
                                    lambda x: x.isNotNull())).alias("byCategory"),
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("section") == "severity", entry)),
                                    lambda x: x.isNotNull())).alias("bySeverity"),
        F.array_sort(F.filter(F.collect_list(F.when(F.col("section") == "contributor", contributor)),
                              lambda x: x.isNotNull())).alias("topContributors"),
    )


def trending_prefixes(messages: DataFrame, hours: float = 24, as_of=None, prefix_len: int = 20,
                      min_frequency: int = 3, limit: int = 10) -> DataFrame:
    """Q7: messages of the last ``hours`` grouped by their case-sensitive
    ``prefix_len``-character prefix, shown lower-cased; frequency must reach
    ``min_frequency`` (the reference's ``> 2``); top ``limit`` by frequency
    (ties keyword asc, then the raw prefix)."""
    prefix = F.substring(F.col("content"), 1, prefix_len)
    return (recent(messages, as_of, hours=hours)
            .groupBy(prefix.alias("prefix"))
            .agg(F.count(F.lit(1)).alias("frequency"))
            .filter(F.col("frequency") >= min_frequency)
            .select(F.lower("prefix").alias("keyword"), "frequency", "prefix")
            .orderBy(F.col("frequency").desc(), F.col("keyword"), F.col("prefix"))
            .limit(limit)
            .select("keyword", "frequency"))


def team_metrics(alerts: DataFrame, messages: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """Q9: per category over the last ``days``: alerts, share of alerts
    younger than one hour at ``as_of`` (whole seconds; named
    ``response_within_1hr`` as in the reference) and distinct reporters."""
    now_s = F.unix_seconds(as_of_col(as_of))
    young = (now_s - F.unix_seconds(F.col("timestamp")) < 3600).cast("long")
    per_msg = (recent(alerts, as_of, days=days)
               .groupBy(*alert_keys(alerts), "category")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(young).alias("n_young")))
    return (join_messages(per_msg, messages, ["author_id"])
            .groupBy("category")
            .agg(F.sum("n").cast("long").alias("alerts_created"),
                 (F.sum("n_young").cast("double") / F.sum("n").cast("double")).alias("response_within_1hr"),
                 F.countDistinct("author_id").alias("unique_reporters"))
            .orderBy(F.col("alerts_created").desc(), F.col("category")))
