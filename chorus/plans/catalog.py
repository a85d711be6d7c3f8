"""Registered queries: one Spark callable and one DuckDB oracle per operator.

Each callable takes ``(spark, sf_dir)``, derives the feedback tables from
the given parquet (``chorus.sources.derived``) and runs one operator over
the whole derived tables with ``as_of`` pinned. Each oracle is one DuckDB
statement over the raw views, starting with the same derivation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chorus.operators import analytics as an
from chorus.schemas import OWN_ENTRY_PREFIX
from chorus.sources import derived as dv

AS_OF = dv.AS_OF
T_AS_OF = f"TIMESTAMP '{AS_OF}'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = dv.ORACLE_PREFIX + oracle
        return fn
    return deco


# When set (bench.py's stored mode), messages and alerts are read from
# tables stored under this folder instead of being derived per query.
STORE_ROOT: str | None = None


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    if STORE_ROOT:
        from chorus.sources import stored
        return stored.read_alerts(spark, STORE_ROOT)
    return dv.alerts(spark, sf_dir)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    if STORE_ROOT:
        from chorus.sources import stored
        return stored.read_messages(spark, STORE_ROOT)
    return dv.messages(spark, sf_dir)


def _tables(spark: SparkSession, sf_dir: str):
    return _alerts(spark, sf_dir), _messages(spark, sf_dir)


def _linked(spark: SparkSession, sf_dir: str):
    """Alerts, messages and the texts that :func:`join_messages` gives to their join: derived
    tables are joined by keys before their documents, stored ones hold their texts."""
    if STORE_ROOT:
        return *_tables(spark, sf_dir), None
    return dv.linked_alerts(spark, sf_dir), dv.linked_messages(spark, sf_dir), dv.alert_texts(spark, sf_dir)


ALERT_SELECT = "a.id, a.message_id, a.category, a.severity, a.summary, a.recommendation, a.timestamp, a.created_at"

# ---------------------------------------------------------------- Q1-Q9


@register("q01_recent_alerts", f"""
SELECT {ALERT_SELECT}, m.author_name, m.content, m.message_url
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
WHERE a.timestamp > {T_AS_OF} - INTERVAL 24 HOUR
ORDER BY a.timestamp DESC, a.id DESC
""")
def q01_recent_alerts(spark, sf_dir):
    a, m, texts = _linked(spark, sf_dir)
    return an.recent_alerts(a, m, hours=24, as_of=AS_OF, texts=texts)


@register("q01_recent_alerts_7d", f"""
SELECT {ALERT_SELECT}, m.author_name, m.content, m.message_url
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
WHERE a.timestamp > {T_AS_OF} - INTERVAL 168 HOUR
""")
def q01_recent_alerts_7d(spark, sf_dir):
    a, m, texts = _linked(spark, sf_dir)
    return an.recent_alerts(a, m, hours=168, as_of=AS_OF, texts=texts)


@register("q02_daily_report", f"""
SELECT CAST(a.timestamp AS DATE) AS date, a.category, count(*) AS count,
       string_agg(DISTINCT m.channel_name, ',' ORDER BY m.channel_name) AS channels
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
WHERE a.timestamp > {T_AS_OF} - INTERVAL 1 DAY
GROUP BY CAST(a.timestamp AS DATE), a.category
""")
def q02_daily_report(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return an.daily_report(a, m, as_of=AS_OF)


@register("q03_hot_topics", f"""
SELECT category, severity, count(*) AS count, avg(length(summary)) AS avg_summary_length
FROM alerts_t WHERE timestamp > {T_AS_OF} - INTERVAL 24 HOUR
GROUP BY category, severity
""")
def q03_hot_topics(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return an.hot_topics(a, hours=24, as_of=AS_OF)


@register("q03_hot_topics_30d", f"""
SELECT category, severity, count(*) AS count, avg(length(summary)) AS avg_summary_length
FROM alerts_t WHERE timestamp > {T_AS_OF} - INTERVAL 720 HOUR
GROUP BY category, severity
""")
def q03_hot_topics_30d(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return an.hot_topics(a, hours=720, as_of=AS_OF)


@register("q04_channel_stats", """
SELECT m.channel_name, count(*) AS message_count, count(DISTINCT m.author_id) AS unique_authors,
       count(a.id) AS alert_count
FROM msgs m LEFT JOIN alerts_t a ON m.message_id = a.message_id
GROUP BY m.channel_name
""")
def q04_channel_stats(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return an.channel_stats(m, a)


@register("q04_channel_stats_distinct", """
SELECT m.channel_name, count(*) AS message_count, count(DISTINCT m.author_id) AS unique_authors,
       coalesce(sum(k.n), 0) AS alert_count
FROM msgs m LEFT JOIN (SELECT message_id, count(*) AS n FROM alerts_t GROUP BY message_id) k
  ON m.message_id = k.message_id
GROUP BY m.channel_name
""")
def q04_channel_stats_distinct(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return an.channel_stats(m, a, distinct_messages=True)


@register("q05_search_alerts", f"""
SELECT {ALERT_SELECT}, m.author_name, m.content, m.channel_name
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
WHERE (m.content ILIKE '%the%' OR a.summary ILIKE '%the%') AND a.category = 'complaint'
ORDER BY a.timestamp DESC, a.id DESC LIMIT 100
""")
def q05_search_alerts(spark, sf_dir):
    a, m, texts = _linked(spark, sf_dir)
    return an.search_alerts(a, m, "the", category="complaint", texts=texts)


@register("q05_search_alerts_filters", f"""
SELECT {ALERT_SELECT}, m.author_name, m.content, m.channel_name
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
WHERE (m.content ILIKE '%N_E%' OR a.summary ILIKE '%N_E%') AND a.severity = 'low'
  AND m.channel_name = 'src3' AND a.timestamp >= TIMESTAMP '2024-01-05 00:00:00'
  AND a.timestamp <= TIMESTAMP '2024-01-25 00:00:00'
ORDER BY a.timestamp DESC, a.id DESC LIMIT 100
""")
def q05_search_alerts_filters(spark, sf_dir):
    a, m, texts = _linked(spark, sf_dir)
    return an.search_alerts(a, m, "N_E", category="", severity="low", channel="src3",
                            start_date="2024-01-05", end_date="2024-01-25", texts=texts)


@register("q06_weekly_report", f"""
SELECT CASE WHEN GROUPING(category) = 1 AND GROUPING(severity) = 1 THEN 'total'
            WHEN GROUPING(severity) = 1 THEN 'category' ELSE 'severity' END AS section,
       CASE WHEN GROUPING(category) = 0 THEN category
            WHEN GROUPING(severity) = 0 THEN coalesce(severity, 'null') END AS key,
       CAST(NULL AS VARCHAR) AS author_name, count(*) AS count, CAST(NULL AS INTEGER) AS rank
FROM alerts_t WHERE timestamp > {T_AS_OF} - INTERVAL 7 DAY
GROUP BY GROUPING SETS ((), (category), (severity))
UNION ALL
SELECT 'contributor' AS section, author_id AS key, author_name, count, CAST(rank AS INTEGER) AS rank
FROM (
  SELECT author_id, max(latest_name) AS author_name, count(*) AS count,
         row_number() OVER (ORDER BY count(*) DESC, author_id) AS rank
  FROM (
    SELECT m.author_id, first_value(m.author_name) OVER (
             PARTITION BY m.author_id ORDER BY m.timestamp DESC, m.id DESC) AS latest_name
    FROM msgs m LEFT JOIN alerts_t a ON m.message_id = a.message_id
    WHERE m.timestamp > {T_AS_OF} - INTERVAL 7 DAY AND a.id IS NOT NULL
  ) j
  GROUP BY author_id
) c WHERE rank <= 5
""")
def q06_weekly_report(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return an.weekly_report_rows(a, m, as_of=AS_OF)


def _prefix_sql(hours: int) -> str:
    return f"""
SELECT lower(left(content, 20)) AS keyword, count(*) AS frequency
FROM msgs WHERE timestamp > {T_AS_OF} - INTERVAL {hours} HOUR
GROUP BY left(content, 20) HAVING count(*) >= 3
ORDER BY frequency DESC, keyword, left(content, 20) LIMIT 10
"""


@register("q07_trending_prefixes", _prefix_sql(24))
def q07_trending_prefixes(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return an.trending_prefixes(m, hours=24, as_of=AS_OF)


@register("q07_trending_prefixes_30d", _prefix_sql(720))
def q07_trending_prefixes_30d(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return an.trending_prefixes(m, hours=720, as_of=AS_OF)


@register("q09_team_metrics", f"""
SELECT a.category, count(*) AS alerts_created,
       avg(CASE WHEN CAST(floor(epoch({T_AS_OF})) AS BIGINT) - CAST(floor(epoch(a.timestamp)) AS BIGINT) < 3600
                THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS response_within_1hr,
       count(DISTINCT m.author_id) AS unique_reporters
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
WHERE a.timestamp > {T_AS_OF} - INTERVAL 30 DAY
GROUP BY a.category
""")
def q09_team_metrics(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return an.team_metrics(a, m, days=30, as_of=AS_OF)


# ---------------------------------------------------------------- Q10-Q30
from pyspark.sql import functions as F  # noqa: E402

from chorus.operators import classify as cl  # noqa: E402
from chorus.operators import ingest as ig  # noqa: E402
from chorus.operators import payload as pl  # noqa: E402
from chorus.operators import relevance as rv  # noqa: E402
from chorus.operators import routing as rt  # noqa: E402

TEAM = "7,,9"
SERVER = dv.MONITOR_GUILD
MONITORED = ["SRC1", "src3"]
INGEST_CUTOFF = "2024-01-15 00:00:00"
PM_ID = "product-owner"
RELEVANT_SQL = r"""author_id NOT IN ('7', '9') AND length(content) + length(regexp_replace(content, '[^\x{10000}-\x{10FFFF}]', '', 'g')) >= 5 AND NOT author_bot
  AND regexp_matches(regexp_replace(content, 'https?://\S+', '', 'g'), '\S')"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(lc: str, words) -> str:
    return "(" + " OR ".join(f"contains({lc}, {_q(w)})" for w in words) + ")"


def _keyword_sql(content: str = "content") -> str:
    """SQL twin of ``classify.keyword_analysis`` (columns requires_alert,
    category, severity, summary, recommendation)."""
    lc = f"lower({content})"
    cat = "CASE " + " ".join(f"WHEN {_any_sql(lc, w)} THEN {_q(c)}" for c, w in cl.KEYWORDS) + " ELSE 'other' END"
    sev = "CASE " + " ".join(f"WHEN {_any_sql(lc, w)} THEN {_q(s)}" for s, w in cl.SEVERITY_KEYWORDS) + \
        f" ELSE {_q(cl.DEFAULT_SEVERITY)} END"
    label = "CASE c " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in cl.CATEGORY_LABELS.items()) + " END"
    rec = "CASE c " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in cl.RECOMMENDATIONS.items()) + " END"
    alert_cats = ", ".join(_q(c) for c in cl.ALERT_CATEGORIES)
    return f"""(SELECT *, c IN ({alert_cats}) AS requires_alert, c AS category,
       CASE WHEN c IN ('bug', 'complaint') THEN s END AS severity,
       {label} || ' (' || CAST(length({content}) AS VARCHAR) || ' chars)' AS summary,
       {rec} AS recommendation
FROM (SELECT *, {cat} AS c, {sev} AS s FROM msgs) k0)"""


@register("q10_relevant_messages", f"""
SELECT id, message_id, channel_name, author_id, content FROM raw_msg WHERE {RELEVANT_SQL}
""")
def q10_relevant_messages(spark, sf_dir):
    raw = dv.raw_message_rows(spark, sf_dir)
    return rv.relevant_messages(raw, team_ids=TEAM).select("id", "message_id", "channel_name", "author_id",
                                                           "content")


@register("q11_ingest_messages", f"""
, incoming AS (
  SELECT *, 0 AS arrival FROM raw_msg
  UNION ALL
  SELECT id, message_id, channel_id, channel_name, author_id, author_name, upper(content) AS content,
         timestamp, message_url, author_bot, guild_name, event_type, 1 AS arrival
  FROM raw_msg WHERE event_type = 'signup'
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY arrival) AS rn
  FROM incoming
  WHERE NOT author_bot AND guild_name = '{SERVER}'
    AND (contains(lower(channel_name), 'src1') OR contains(lower(channel_name), 'src3'))
    AND {RELEVANT_SQL}
)
SELECT message_id, channel_id, channel_name, author_id, author_name, content,
       date_trunc('millisecond', timestamp) AS timestamp, message_url, {T_AS_OF} AS created_at
FROM kept r
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM msgs t WHERE t.message_id = r.message_id
                             AND t.timestamp < TIMESTAMP '{INGEST_CUTOFF}')
""")
def q11_ingest_messages(spark, sf_dir):
    raw, texts = dv.linked_message_rows(spark, sf_dir), dv.message_texts(spark, sf_dir)
    links = [c for c in texts.links if c != "edited"]
    first = dv.events_from_rows(raw, links).withColumns({"arrival": F.lit(0), "edited": F.lit(False)})
    # Signup messages are delivered twice; the later copy is edited.
    again = dv.events_from_rows(raw.filter(F.col("event_type") == "signup"), links) \
        .withColumns({"content": F.upper("content"), "arrival": F.lit(1), "edited": F.lit(True)})
    stored = _messages(spark, sf_dir).filter(F.col("timestamp") < F.lit(INGEST_CUTOFF).cast("timestamp"))
    return ig.ingest_messages(first.unionByName(again), stored, SERVER, MONITORED, TEAM,
                              as_of=AS_OF, arrival_col="arrival", texts=texts)


@register("q12_classify_messages", f"""
SELECT message_id, requires_alert, category, severity, summary, recommendation, 'ok' AS parse_status
FROM {_keyword_sql()} k
""")
def q12_classify_messages(spark, sf_dir):
    m = _messages(spark, sf_dir).select("message_id", "content")
    return cl.analyse_messages(m).drop("content")


@register("q12_parse_conversation_replies", """
SELECT conv_id, turn, false AS requires_alert, 'other' AS category, CAST(NULL AS VARCHAR) AS severity,
       'Analysis inconclusive' AS summary, 'Review manually' AS recommendation,
       CASE WHEN regexp_matches(text, '[{]') AND regexp_matches(text, '[}]') THEN 'check' ELSE 'no_json' END
         AS parse_status
FROM conversations WHERE role = 'assistant'
""")
def q12_parse_conversation_replies(spark, sf_dir):
    from chorus.sources.tables import read_table
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return cl.parse_analysis(c.select("conv_id", "turn", F.col("text").alias("response")))


@register("q13_store_alerts", f"""
SELECT message_id, category, severity, summary, recommendation, {T_AS_OF} AS timestamp
FROM {_keyword_sql()} k WHERE requires_alert
""")
def q13_store_alerts(spark, sf_dir):
    m = _messages(spark, sf_dir).select("message_id", "content")
    return rt.alert_rows(cl.analyse_messages(m), as_of=AS_OF)


@register("q13_bug_reports", f"""
SELECT id, '{OWN_ENTRY_PREFIX} ' || summary AS subject,
       'Original Message ID: ' || message_id || chr(10) || 'Recommendation: ' || recommendation AS description,
       coalesce(nullif(severity, ''), 'medium') AS severity, 'open' AS status,
       CAST(floor(epoch(timestamp)) AS BIGINT) AS created_at
FROM alerts_t WHERE category = 'bug'
""")
def q13_bug_reports(spark, sf_dir):
    return rt.bug_report_rows(_alerts(spark, sf_dir))


@register("q13_feature_suggestions", f"""
SELECT id, '{OWN_ENTRY_PREFIX} ' || summary AS title, 'Original Message ID: ' || message_id AS description,
       recommendation AS "useCase", 'medium' AS priority, 'open' AS status,
       strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "createdAt",
       strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "updatedAt"
FROM alerts_t WHERE category = 'feature_request'
""")
def q13_feature_suggestions(spark, sf_dir):
    return rt.feature_suggestion_rows(_alerts(spark, sf_dir))


from chorus.operators import commands as cm  # noqa: E402
from chorus.operators import duplicates as du  # noqa: E402
from chorus.operators import quality as qa  # noqa: E402
from chorus.streaming import monitor as mo  # noqa: E402

MONITOR_START = "2024-01-15 00:00:00"
from chorus.schemas import ISSUE_BODY_FORMAT  # noqa: E402


def _alerts_with_messages(spark, sf_dir):
    from chorus.operators.joins import join_messages
    a, m, texts = _linked(spark, sf_dir)
    return join_messages(a.withColumnRenamed("id", "alert_id"), m,
                         ["content", "author_name", "author_id", "channel_name", "message_url"], texts=texts)


AWM_SQL = """(SELECT a.id AS alert_id, a.message_id, a.category, a.severity, a.summary, a.recommendation,
        a.timestamp, m.content, m.author_name, m.author_id, m.channel_name, m.message_url
 FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id)"""

COLOR_SQL = """CASE {s} WHEN 'critical' THEN 16711680 WHEN 'high' THEN 16737792 WHEN 'medium' THEN 16763904
  WHEN 'low' THEN 52224 ELSE 3447003 END"""
EMOJI_SQL = """CASE category WHEN 'bug' THEN '🐛' WHEN 'feature_request' THEN '✨' WHEN 'complaint' THEN '⚠️'
  WHEN 'praise' THEN '👍' WHEN 'documentation' THEN '📚' WHEN 'other' THEN '💬' ELSE '💬' END"""


@register("q08_duplicate_bugs", f"""
, cand AS (
  SELECT a.id, a.summary,
         list_distinct(list_filter(regexp_split_to_array(lower(a.summary), '\\W+'), lambda t: t <> '')) AS tk
  FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
  WHERE a.category = 'bug' AND a.timestamp > {T_AS_OF} - INTERVAL 30 DAY
), q AS (
  SELECT arg_min(tk, id) AS qk FROM cand
), s AS (
  SELECT id, summary,
         CAST(len(list_intersect(tk, qk)) AS DOUBLE) / CAST(len(list_distinct(list_concat(tk, qk))) AS DOUBLE)
           AS score
  FROM cand, q
)
SELECT id, summary, score FROM s WHERE score >= 0.3
""")
def q08_duplicate_bugs(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    cand = du.bug_candidates(a, m, days=30, as_of=AS_OF)
    # the oldest candidate stands for a new report
    return du.duplicate_bugs(cand, du.oldest_summary(cand), 0.3).select("id", "summary", "score")


@register("q14_route_alerts", f"""
SELECT 'alert' AS source, alert_id AS source_id, s.seq, CASE WHEN category = 'feature_request'
         THEN '⚙️║feature-suggestions' ELSE '❗║error-handling' END AS target_channel, s.content
FROM {AWM_SQL} x,
  (SELECT 0 AS seq, CAST(NULL AS VARCHAR) AS content UNION ALL SELECT 1, NULL) s
WHERE s.seq = 0 OR x.category IN ('bug', 'feature_request')
""")
def q14_route_alerts(spark, sf_dir):
    r = pl.route_alerts(_alerts_with_messages(spark, sf_dir))
    return r.select("source", "source_id", "seq", "target_channel",
                    F.when(F.col("seq") == 1, F.lit(None).cast("string")).otherwise(F.col("content"))
                    .alias("content"))


@register("q15_alert_payloads", f"""
SELECT alert_id, {COLOR_SQL.format(s='severity')} AS color,
  {EMOJI_SQL} || ' ' || upper(replace(category, '_', ' ')) AS title,
  summary AS summary_value,
  coalesce(nullif(substr(content, 1, 1024), ''), 'No content') AS message_value,
  author_name || ' in #' || channel_name AS from_value,
  coalesce(nullif(upper(severity), ''), 'N/A') AS severity_value,
  coalesce(nullif(recommendation, ''), 'Review message') AS recommendation_value,
  'Automated Feedback Analysis' AS footer,
  CASE WHEN coalesce(message_url, '') <> '' THEN '[Jump to message](' || message_url || ')' END AS link_value
FROM {AWM_SQL} x
""")
def q15_alert_payloads(spark, sf_dir):
    e = pl.alert_embed_columns(_alerts_with_messages(spark, sf_dir))
    return e.select("alert_id", "color", "title", "summary_value", "message_value", "from_value",
                    "severity_value", "recommendation_value", "footer", "link_value")


def _monitor_sql(table: str, title: str, kind: str) -> str:
    start = f"CAST(floor(epoch(TIMESTAMP '{MONITOR_START}')) AS BIGINT)" if kind == "bug" else \
        f"strftime(TIMESTAMP '{MONITOR_START}', '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
    created = "created_at" if kind == "bug" else '"createdAt"'
    level = "severity" if kind == "bug" else "priority"
    target = "❗║error-handling" if kind == "bug" else "⚙️║feature-suggestions"
    head = "🐛 NEW BUG REPORT" if kind == "bug" else "💡 NEW FEATURE SUGGESTION"
    return f"""
, mark AS (SELECT coalesce(max(id), 0) AS mk FROM {table} WHERE {created} < {start})
SELECT 'monitor' AS source, id AS source_id, 0 AS seq, '{target}' AS target_channel,
  {COLOR_SQL.format(s=f"nullif({level}, '')")} AS color, '{head}' AS title,
  coalesce(nullif({title}, ''), 'No title') AS subject_value,
  substr(coalesce(nullif(description, ''), 'No description'), 1, 1024) AS description_value,
  coalesce(nullif(upper(status), ''), 'OPEN') AS status_value,
  upper(coalesce(nullif({level}, ''), 'MEDIUM')) AS level_value
FROM {table}, mark
WHERE id > mk AND NOT coalesce(starts_with({title}, '{OWN_ENTRY_PREFIX}'), false)
"""


def _monitor_q(spark, sf_dir, kind):
    table = dv.bug_reports(spark, sf_dir) if kind == "bug" else dv.feature_suggestions(spark, sf_dir)
    if kind == "bug":
        before = F.col("created_at") < F.unix_seconds(F.lit(MONITOR_START).cast("timestamp"))
    else:
        before = F.col("createdAt") < F.date_format(F.lit(MONITOR_START).cast("timestamp"),
                                                     "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    mark = mo.start_mark(table.filter(before))
    e = pl.external_embed_columns(mo.new_external_entries(table, kind, mark), kind)
    target = "❗║error-handling" if kind == "bug" else "⚙️║feature-suggestions"
    return e.select(F.lit("monitor").alias("source"), F.col("id").alias("source_id"), F.lit(0).alias("seq"),
                    F.lit(target).alias("target_channel"), "color", F.col("heading").alias("title"), "subject_value",
                    "description_value", "status_value", "level_value")


@register("q16_monitor_bug_reports", _monitor_sql("bugs_t", "subject", "bug"))
def q16_monitor_bug_reports(spark, sf_dir):
    return _monitor_q(spark, sf_dir, "bug")


@register("q16_monitor_feature_suggestions", _monitor_sql("features_t", "title", "feature"))
def q16_monitor_feature_suggestions(spark, sf_dir):
    return _monitor_q(spark, sf_dir, "feature")


@register("q18_recent_alerts_view", f"""
SELECT a.id AS alert_id, upper(replace(a.category, '_', ' ')) AS title, a.summary AS description,
  coalesce(nullif(m.author_name, ''), 'Unknown') AS author, coalesce(nullif(a.severity, ''), 'N/A') AS severity,
  substr(m.content, 1, 100) || '...' AS message,
  CASE WHEN a.severity = 'critical' THEN 16711680 ELSE 3447003 END AS color, a.timestamp
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
WHERE a.timestamp > {T_AS_OF} - INTERVAL 24 HOUR
ORDER BY a.timestamp DESC, a.id DESC LIMIT 10
""")
def q18_recent_alerts_view(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return cm.recent_alerts_view(a, m, hours=0, as_of=AS_OF)


@register("q19_search_view", """
, res AS (
  SELECT a.category, a.summary, row_number() OVER (ORDER BY a.timestamp DESC, a.id DESC) AS rn
  FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
  WHERE (m.content ILIKE '%the%' OR a.summary ILIKE '%the%') AND a.category = 'bug'
  ORDER BY a.timestamp DESC, a.id DESC LIMIT 100
)
SELECT 'Search Results (' || CAST(count(*) AS VARCHAR) || ' found)' AS title,
  CASE WHEN count(*) = 0 THEN 'No results found for your search.' ELSE
    string_agg(CASE WHEN rn <= 5 THEN CAST(rn AS VARCHAR) || '. **' || category || '** - ' || summary END,
               chr(10) ORDER BY rn) END AS description,
  count(*) AS found
FROM res
""")
def q19_search_view(spark, sf_dir):
    a, m, texts = _linked(spark, sf_dir)
    return cm.search_view(a, m, "the", category="bug", texts=texts)


@register("q20_stats_view", f"""
, rep AS (
  SELECT CAST(a.timestamp AS DATE) AS date, a.category, count(*) AS count
  FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id
  WHERE a.timestamp > {T_AS_OF} - INTERVAL 1 DAY
  GROUP BY 1, 2 ORDER BY date DESC, count DESC, category LIMIT 10
)
SELECT CASE WHEN count(*) = 0 THEN 'No data available' ELSE
  string_agg('**' || category || '**: ' || CAST(count AS VARCHAR) || ' alerts', chr(10)
             ORDER BY date DESC, count DESC, category) END AS description
FROM rep
""")
def q20_stats_view(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return cm.stats_view(a, m, as_of=AS_OF)


@register("q21_critical_bug_notices", f"""
SELECT alert_id, 'dev-critical-alerts' AS target_channel, '@here CRITICAL BUG REPORTED' AS notice,
  {EMOJI_SQL} || ' ' || upper(replace(category, '_', ' ')) AS title, {COLOR_SQL.format(s='severity')} AS color
FROM {AWM_SQL} x WHERE severity = 'critical' AND category = 'bug'
""")
def q21_critical_bug_notices(spark, sf_dir):
    e = pl.alert_embed_columns(pl.critical_bug_notices(_alerts_with_messages(spark, sf_dir)))
    return e.select("alert_id", "target_channel", "notice", "title", "color")


@register("q22_support_tickets", """
SELECT a.id AS alert_id, a.summary AS title, m.content AS description, a.category, a.severity,
       m.author_name AS reported_by, m.message_url AS message_link
FROM alerts_t a JOIN msgs m ON a.message_id = m.message_id WHERE a.category IN ('bug', 'complaint')
""")
def q22_support_tickets(spark, sf_dir):
    a, m, texts = _linked(spark, sf_dir)
    return rt.support_ticket_rows(a, m, texts)


@register("q23_feature_notices", f"""
SELECT alert_id, '{PM_ID}' AS recipient, 'New feature request: ' || summary AS notice
FROM {AWM_SQL} x WHERE category = 'feature_request'
""")
def q23_feature_notices(spark, sf_dir):
    return pl.feature_notices(_alerts_with_messages(spark, sf_dir), PM_ID) \
        .select("alert_id", "recipient", "notice")


def _sentiment_sql() -> str:
    lc = "lower(content)"
    pos = " + ".join(f"CAST(contains({lc}, {_q(w)}) AS INTEGER)" for w in cl.POSITIVE_WORDS)
    neg = " + ".join(f"CAST(contains({lc}, {_q(w)}) AS INTEGER)" for w in cl.NEGATIVE_WORDS)
    return f"round(CAST(({pos}) + 1 AS DOUBLE) / CAST(({pos}) + ({neg}) + 2 AS DOUBLE), 2)"


@register("q24_sentiment", f"""
SELECT message_id, category, requires_alert, {_sentiment_sql()} AS sentiment FROM {_keyword_sql()} k
""")
def q24_sentiment(spark, sf_dir):
    m = _messages(spark, sf_dir).select("message_id", "content")
    return cl.analyse_messages(cl.add_sentiment(m)) \
        .select("message_id", "category", "requires_alert", "sentiment")


@register("q25_resolve_alerts", """
, latest AS (
  SELECT message_id, arg_max(note, (resolved_at, note)) AS note, max(resolved_at) AS resolved_at
  FROM resolutions_t GROUP BY message_id
)
SELECT a.id, a.message_id, a.category,
  CASE WHEN l.message_id IS NOT NULL THEN true END AS resolved,
  l.note AS resolution_note, l.resolved_at
FROM alerts_t a LEFT JOIN latest l ON a.message_id = l.message_id
""")
def q25_resolve_alerts(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return rt.resolve_alerts(a, dv.resolutions(spark, sf_dir, a)) \
        .select("id", "message_id", "category", "resolved", "resolution_note", "resolved_at")


@register("q25_resolution_notices", """
, latest AS (
  SELECT message_id, arg_max(note, (resolved_at, note)) AS note FROM resolutions_t GROUP BY message_id
)
SELECT l.message_id, m.author_id AS recipient, '✅ Your feedback has been addressed: ' || l.note AS notice
FROM latest l JOIN msgs m ON l.message_id = m.message_id
""")
def q25_resolution_notices(spark, sf_dir):
    latest = rt.latest_resolutions(dv.resolutions(spark, sf_dir))
    m = _messages(spark, sf_dir).select("message_id", "author_id")
    return pl.resolution_notices(latest.join(m, "message_id"))


@register("q26_issue_payloads", f"""
SELECT alert_id, message_id, summary AS title,
  printf({_q(ISSUE_BODY_FORMAT)}, content, author_name, message_url) AS body
FROM {AWM_SQL} x WHERE severity = 'critical' AND category = 'bug'
""")
def q26_issue_payloads(spark, sf_dir):
    return pl.issue_payloads(_alerts_with_messages(spark, sf_dir)).select("alert_id", "message_id", "title",
                                                                          "body")


def _backlog_sql(hours: int) -> str:
    return f"""
SELECT message_id, channel_name, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_name ORDER BY timestamp DESC, message_id DESC) AS rk
  FROM msgs WHERE timestamp >= {T_AS_OF} - INTERVAL {hours} HOUR
) b WHERE rk <= 100
"""


@register("q27_backlog_24h", _backlog_sql(24))
def q27_backlog_24h(spark, sf_dir):
    return ig.backlog(_messages(spark, sf_dir), as_of=AS_OF, hours_back=24) \
        .select("message_id", "channel_name", "timestamp")


@register("q27_backlog_7d", _backlog_sql(168))
def q27_backlog_7d(spark, sf_dir):
    return ig.backlog(_messages(spark, sf_dir), as_of=AS_OF, hours_back=168) \
        .select("message_id", "channel_name", "timestamp")


@register("q28_template_bug_tracking", """
SELECT id, category, severity, 'critical-bugs' AS target_channel FROM alerts_t
WHERE category IN ('bug') AND CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2
  WHEN 'low' THEN 1 END >= 2
""")
def q28_template_bug_tracking(spark, sf_dir):
    return rt.apply_template(_alerts(spark, sf_dir), "BUG_TRACKING") \
        .select("id", "category", "severity", "target_channel")


@register("q28_template_product_feedback", """
SELECT id, category, severity, CASE category WHEN 'feature_request' THEN 'feature-ideas' WHEN 'praise' THEN 'wins'
  END AS target_channel FROM alerts_t WHERE category IN ('feature_request', 'praise')
""")
def q28_template_product_feedback(spark, sf_dir):
    return rt.apply_template(_alerts(spark, sf_dir), "PRODUCT_FEEDBACK") \
        .select("id", "category", "severity", "target_channel")


@register("q28_template_full_feedback", """
SELECT id, category, severity, CASE category WHEN 'bug' THEN 'bugs' WHEN 'feature_request' THEN 'feature-requests'
  WHEN 'complaint' THEN 'complaints' WHEN 'praise' THEN 'praise' WHEN 'documentation' THEN 'docs' END
  AS target_channel
FROM alerts_t WHERE category IN ('bug', 'feature_request', 'complaint', 'praise', 'documentation')
""")
def q28_template_full_feedback(spark, sf_dir):
    return rt.apply_template(_alerts(spark, sf_dir), "FULL_FEEDBACK") \
        .select("id", "category", "severity", "target_channel")


def _quality_sql() -> str:
    from chorus.schemas import ALERTS, MESSAGES
    rows = []
    for table, schema, src, key in (("messages", MESSAGES, "msgs", "message_id"), ("alerts", ALERTS, "alerts_t", "id")):
        for f in schema.fields:
            if not f.nullable:
                rows.append(f"SELECT '{table}' AS \"table\", 'not_null:{f.name}' AS rule, "
                            f"count(*) FILTER (WHERE \"{f.name}\" IS NULL) AS violations FROM {src}")
    cats = ", ".join(_q(c) for c in ["bug", "feature_request", "complaint", "praise", "documentation", "other"])
    rows += [
        "SELECT 'messages', 'unique:message_id', count(*) FROM (SELECT message_id FROM msgs GROUP BY message_id "
        "HAVING count(*) > 1) d",
        "SELECT 'alerts', 'foreign_key:message_id', count(*) FROM alerts_t a WHERE NOT EXISTS "
        "(SELECT 1 FROM msgs m WHERE m.message_id = a.message_id)",
        f"SELECT 'alerts', 'domain:category', count(*) FILTER (WHERE category NOT IN ({cats})) FROM alerts_t",
        "SELECT 'alerts', 'domain:severity', count(*) FILTER (WHERE severity IS NOT NULL AND severity NOT IN "
        "('critical', 'high', 'medium', 'low')) FROM alerts_t",
    ]
    return "\n" + "\nUNION ALL\n".join(rows) + "\n"


@register("q29_constraint_checks", _quality_sql())
def q29_constraint_checks(spark, sf_dir):
    a, m = _tables(spark, sf_dir)
    return qa.validate(m, a)


@register("q30_team_member_messages", """
SELECT message_id, author_id, channel_name FROM raw_msg WHERE author_id IN ('7', '9')
""")
def q30_team_member_messages(spark, sf_dir):
    raw = dv.raw_message_rows(spark, sf_dir)
    return raw.filter(rv.is_team_member(F.col("author_id"), TEAM)).select("message_id", "author_id",
                                                                            "channel_name")


@register("q17_external_payloads", f"""
SELECT 'feature' AS kind, id AS source_id, {COLOR_SQL.format(s="nullif(priority, '')")} AS color,
  '💡 NEW FEATURE SUGGESTION' AS title, coalesce(nullif(title, ''), 'No title') AS subject_value,
  substr(coalesce(nullif(description, ''), 'No description'), 1, 1024) AS description_value,
  coalesce(nullif(upper(status), ''), 'OPEN') AS status_value,
  upper(coalesce(nullif(priority, ''), 'MEDIUM')) AS level_value,
  CAST(strptime("createdAt", '%Y-%m-%dT%H:%M:%S.%gZ') AS TIMESTAMP) AS embed_time
FROM features_t
UNION ALL
SELECT 'bug', id, {COLOR_SQL.format(s="nullif(severity, '')")}, '🐛 NEW BUG REPORT',
  coalesce(nullif(subject, ''), 'No title'),
  substr(coalesce(nullif(description, ''), 'No description'), 1, 1024),
  coalesce(nullif(upper(status), ''), 'OPEN'), upper(coalesce(nullif(severity, ''), 'MEDIUM')),
  make_timestamp(created_at * 1000000)
FROM bugs_t
""")
def q17_external_payloads(spark, sf_dir):
    cols = ["source_id", "color", F.col("heading").alias("title"), "subject_value", "description_value",
            "status_value", "level_value", "embed_time"]
    f = pl.external_embed_columns(dv.feature_suggestions(spark, sf_dir), "feature") \
        .select(F.lit("feature").alias("kind"), F.col("id").alias("source_id"), *cols[1:])
    b = pl.external_embed_columns(dv.bug_reports(spark, sf_dir), "bug") \
        .select(F.lit("bug").alias("kind"), F.col("id").alias("source_id"), *cols[1:])
    return f.unionByName(b)
