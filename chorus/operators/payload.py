"""Notification payloads and routing (Q14, Q15, Q17, Q21, Q23, Q25 notice,
Q26).

A payload ("embed") is a struct column; its ``fields`` are an array of
``struct<name, value, inline>``. Notification rows are what the sink
appends to the ``notifications`` table (partitioned by target channel);
delivering them to a chat service is outside Spark.

The channel dimension (a guild's channels) is asked for the two channels that
alerts go to, once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.functions.columns import iso_text, js_or, map_lookup, upper_words
from chorus.schemas import (
    ALERT_CHANNEL_NAME,
    ALERT_FOOTER,
    BUG_CONFIRMATION,
    CATEGORY_EMOJIS,
    CRITICAL_BUG_TEXT,
    CRITICAL_CHANNEL_NAME,
    DEFAULT_COLOR,
    DEFAULT_EMOJI,
    FEATURE_CHANNEL_NAME,
    FEATURE_CONFIRMATION,
    FEATURE_NOTICE_PREFIX,
    ISSUE_BODY_FORMAT,
    ISSUE_LABELS,
    MONITOR_FOOTER,
    RESOLVED_NOTICE_PREFIX,
    SEVERITY_COLORS,
)

# Limits of the embed format (fixed values).
FIELD_VALUE_LIMIT = 1024


def _field(name: str, value: Column, inline: bool) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))


def alert_color(severity: Column) -> Column:
    return map_lookup(SEVERITY_COLORS, severity, DEFAULT_COLOR)


def alert_embed_columns(df: DataFrame) -> DataFrame:
    """Q15 in flat form: the embed's parts as columns.

    Expects ``category, severity, summary, recommendation`` (analysis) and
    ``content, author_name, channel_name, message_url, attachments``
    (original message; ``attachments`` optional).
    """
    att = F.col("attachments") if "attachments" in df.columns else \
        F.array().cast("array<struct<name:string,url:string,contentType:string>>")
    first = F.try_element_at(att, F.lit(1))
    has_att = F.coalesce(F.size(att), F.lit(0)) > 0
    emoji = map_lookup(CATEGORY_EMOJIS, F.col("category"), DEFAULT_EMOJI)
    return df.select(
        "*",
        alert_color(F.col("severity")).alias("color"),
        F.concat(emoji, F.lit(" "), upper_words(F.col("category"))).alias("title"),
        F.col("summary").alias("summary_value"),
        js_or(F.substring(F.col("content"), 1, FIELD_VALUE_LIMIT), "No content").alias("message_value"),
        F.concat(F.col("author_name"), F.lit(" in #"), F.col("channel_name")).alias("from_value"),
        js_or(F.upper(F.col("severity")), "N/A").alias("severity_value"),
        js_or(F.col("recommendation"), "Review message").alias("recommendation_value"),
        F.lit(ALERT_FOOTER).alias("footer"),
        F.when(js_or(F.col("message_url"), F.lit(None).cast("string")).isNotNull(),
               F.concat(F.lit("[Jump to message]("), F.col("message_url"), F.lit(")"))).alias("link_value"),
        F.when(has_att & F.coalesce(first["contentType"].startswith("image/"), F.lit(False)),
               first["url"]).alias("image_url"),
        F.when(has_att, F.array_join(F.transform(att, lambda a: F.concat(
            F.lit("["), a["name"], F.lit("]("), a["url"], F.lit(")"))), "\n")).alias("media_value"),
        F.when(has_att, F.transform(att, lambda a: a["url"])).otherwise(F.array().cast("array<string>"))
        .alias("files"),
        (F.col("timestamp") if "timestamp" in df.columns else F.current_timestamp()).alias("embed_time"),
    )


def alert_embed(df: DataFrame) -> Column:
    """Q15 as one struct column over :func:`alert_embed_columns` output."""
    fields = F.array(
        _field("Summary", F.col("summary_value"), False),
        _field("Original Message", F.col("message_value"), False),
        _field("From", F.col("from_value"), True),
        _field("Severity", F.col("severity_value"), True),
        _field("Recommendation", F.col("recommendation_value"), False),
        F.when(F.col("link_value").isNotNull(), _field("Message Link", F.col("link_value"), False)),
        F.when(F.col("media_value").isNotNull(), _field("Media Attachments", F.col("media_value"), False)),
    )
    return F.struct(
        F.col("color"), F.col("title"),
        F.filter(fields, lambda x: x.isNotNull()).alias("fields"),
        F.col("footer"), iso_text(F.col("embed_time")).alias("timestamp"), F.col("image_url").alias("image"),
    )


def has_text_channel(channels: DataFrame, name: str) -> Column:
    """Whether a text channel has this name, letter case aside."""
    return channels.filter((F.col("type") == "text") & (F.lower("name") == F.lower(F.lit(name)))).exists()


def route_alerts(df: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Q14: notification rows for alerts.

    feature_request → the feature channel, any other category → the error
    channel. The channel must exist as a text channel (case-folded name);
    if ``channels`` is given, alerts whose channel is missing are dropped.
    A bug or feature_request yields a second, confirmation row (seq 1).
    Expects an alert id column ``alert_id`` plus the Q15 inputs.
    """
    target = F.when(F.col("category") == "feature_request", F.lit(FEATURE_CHANNEL_NAME)) \
        .otherwise(F.lit(ALERT_CHANNEL_NAME))
    e = alert_embed_columns(df.withColumn("target_channel", target))
    e = e.withColumn("embed", alert_embed(e))
    if channels is not None:
        # Two targets, so two existence tests, whatever the size of either table: scalar
        # subqueries that Spark evaluates once, instead of a join of all alerts.
        e = e.filter(F.when(F.col("category") == "feature_request", has_text_channel(channels, FEATURE_CHANNEL_NAME))
                     .otherwise(has_text_channel(channels, ALERT_CHANNEL_NAME)))
    confirm = F.when(F.col("category") == "bug", F.lit(BUG_CONFIRMATION)) \
        .when(F.col("category") == "feature_request", F.lit(FEATURE_CONFIRMATION))
    # Only (seq, text) goes through the explode; the embed and the files
    # are set on the seq-0 row after it. Catalyst does not prune unused
    # fields of structs built inside the exploded array, so a caller that
    # does not read the embed would still build it (and join the message
    # text it quotes); outside the array it is pruned.
    msgs = F.filter(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit(None).cast("string").alias("content")),
        F.when(confirm.isNotNull(), F.struct(F.lit(1).alias("seq"), confirm.alias("content"))),
    ), lambda x: x.isNotNull())
    first = F.col("m.seq") == 0
    return (e.select(F.col("alert_id").alias("source_id"), "target_channel", "embed", "files",
                     F.explode(msgs).alias("m"))
            .select(F.lit("alert").alias("source"), "source_id", F.col("m.seq").alias("seq"),
                    "target_channel", F.lit(None).cast("string").alias("recipient"),
                    F.col("m.content").alias("content"),
                    F.when(first, F.to_json(F.col("embed"))).alias("embed_json"),
                    F.when(first, F.col("files")).otherwise(F.array().cast("array<string>")).alias("files")))


def external_embed_columns(df: DataFrame, kind: str) -> DataFrame:
    """Q17 in flat form for rows of ``bug_reports`` (kind ``bug``) or
    ``feature_suggestions`` (kind ``feature``)."""
    def opt(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")
    level = F.coalesce(F.nullif(opt("severity"), F.lit("")), F.nullif(opt("priority"), F.lit("")))
    if "created_at" in df.columns:
        when = F.when(F.coalesce(F.col("created_at"), F.lit(0)) != 0, F.timestamp_seconds(F.col("created_at")))
    elif "createdAt" in df.columns:
        when = F.try_to_timestamp(F.col("createdAt"))
    else:
        when = F.lit(None).cast("timestamp")
    emoji, title = ("🐛", "NEW BUG REPORT") if kind == "bug" else ("💡", "NEW FEATURE SUGGESTION")
    return df.select(
        "*",
        alert_color(level).alias("color"),
        F.lit(f"{emoji} {title}").alias("heading"),
        js_or(opt("subject"), js_or(opt("title"), "No title")).alias("subject_value"),
        F.substring(js_or(opt("description"), "No description"), 1, FIELD_VALUE_LIMIT).alias("description_value"),
        js_or(F.upper(opt("status")), "OPEN").alias("status_value"),
        F.upper(F.coalesce(level, F.lit("MEDIUM"))).alias("level_value"),
        F.lit(MONITOR_FOOTER).alias("footer"),
        F.coalesce(when, F.current_timestamp()).alias("embed_time"),
        F.nullif(opt("url"), F.lit("")).alias("url_value"),
    )


def external_embed(df: DataFrame) -> Column:
    fields = F.array(
        _field("Subject/Title", F.col("subject_value"), False),
        _field("Description", F.col("description_value"), False),
        _field("Status", F.col("status_value"), True),
        _field("Severity/Priority", F.col("level_value"), True),
        F.when(F.col("url_value").isNotNull(), _field("URL", F.col("url_value"), False)),
    )
    return F.struct(F.col("color"), F.col("heading").alias("title"),
                    F.filter(fields, lambda x: x.isNotNull()).alias("fields"),
                    F.col("footer"), F.col("embed_time").alias("timestamp"))


def route_external(df: DataFrame, kind: str) -> DataFrame:
    """Q16/W7: notification rows for external bug / feature entries: bugs to
    the error channel, features to the feature channel."""
    target = ALERT_CHANNEL_NAME if kind == "bug" else FEATURE_CHANNEL_NAME
    e = external_embed_columns(df, kind)
    return e.select(
        F.lit("monitor").alias("source"), F.col("id").alias("source_id"), F.lit(0).alias("seq"),
        F.lit(target).alias("target_channel"), F.lit(None).cast("string").alias("recipient"),
        F.lit(None).cast("string").alias("content"), F.to_json(external_embed(e)).alias("embed_json"),
        F.array().cast("array<string>").alias("files"),
    )


def critical_bug_notices(df: DataFrame) -> DataFrame:
    """Q21: critical bugs → the dev-critical channel with an @here text."""
    return df.filter((F.col("severity") == "critical") & (F.col("category") == "bug")) \
        .withColumn("target_channel", F.lit(CRITICAL_CHANNEL_NAME)) \
        .withColumn("notice", F.lit(CRITICAL_BUG_TEXT))


def feature_notices(df: DataFrame, recipient: str) -> DataFrame:
    """Q23: feature requests → a direct notice to the product owner."""
    return df.filter(F.col("category") == "feature_request") \
        .withColumn("recipient", F.lit(recipient)) \
        .withColumn("notice", F.concat(F.lit(FEATURE_NOTICE_PREFIX), F.col("summary")))


def resolution_notice(note: Column) -> Column:
    return F.concat(F.lit(RESOLVED_NOTICE_PREFIX), note)


def resolution_notices(resolved: DataFrame) -> DataFrame:
    """Q25: one notice per resolved message to its author."""
    return resolved.select(
        "message_id", F.col("author_id").alias("recipient"),
        resolution_notice(F.col("resolution_note")).alias("notice"))


def issue_payloads(df: DataFrame) -> DataFrame:
    """Q26: critical bugs → an issue document (JSON text) with a fenced
    body quoting the message, reporter and link."""
    body = F.format_string(ISSUE_BODY_FORMAT, F.col("content"), F.col("author_name"), F.col("message_url"))
    crit = df.filter((F.col("severity") == "critical") & (F.col("category") == "bug"))
    return crit.select(
        *[c for c in ("alert_id", "message_id") if c in df.columns],
        F.col("summary").alias("title"), body.alias("body"),
        F.to_json(F.struct(F.col("summary").alias("title"), body.alias("body"),
                           F.array(*[F.lit(x) for x in ISSUE_LABELS]).alias("labels"),
                           F.lit("critical").alias("priority"))).alias("issue_json"))
