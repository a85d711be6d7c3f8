"""From analysed messages to stored rows (Q13, Q22, Q25, Q28).

Every function is a projection/filter over a DataFrame; the split into
alerts, bug reports and feature suggestions reads one persisted batch and
writes several outputs (see ``chorus.plans.feedback_flow``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions.columns import as_of_col, blank_to_null, iso_text
from chorus.operators.joins import LinkedTexts, alert_keys, join_messages
from chorus.schemas import CONFIG_TEMPLATES, OWN_ENTRY_PREFIX, SEVERITY_RANK

ALERT_ROW_COLUMNS = ["message_id", "category", "severity", "summary", "recommendation", "timestamp"]


def alert_rows(analysed: DataFrame, as_of=None, keep: Sequence[str] = ()) -> DataFrame:
    """Q13 step 1: analysed messages that require an alert become alert rows
    (``severity || null``; timestamp = the alert's creation time); ``keep``: further columns.

    Rows violating NOT NULL on message_id / category / summary are left out here and
    returned by :func:`quarantine_rows`.
    """
    ok = (F.col("requires_alert") & (F.col("parse_status") == "ok")
          & F.col("message_id").isNotNull() & F.col("category").isNotNull() & F.col("summary").isNotNull())
    # A stored message's date partition travels with its alert (joins.DATE_LINK).
    link = [F.col("dt").alias("message_dt")] if "dt" in analysed.columns else []
    return analysed.filter(ok).select(
        "message_id", "category",
        blank_to_null(F.col("severity")).alias("severity"),
        "summary", "recommendation",
        as_of_col(as_of).alias("timestamp"),
        *link, *keep,
    )


def quarantine_rows(analysed: DataFrame) -> DataFrame:
    """Messages whose analysis could not be stored: bad JSON, a model error, or an alert
    missing a NOT NULL column. ``reason`` says which."""
    reason = (F.when(F.col("parse_status") == "bad_json", F.lit("bad_json"))
              .when(F.col("parse_status") == "model_error", F.lit("model_error"))
              .when(F.col("requires_alert") & F.col("message_id").isNull(), F.lit("message_id_null"))
              .when(F.col("requires_alert") & F.col("category").isNull(), F.lit("category_null"))
              .when(F.col("requires_alert") & F.col("summary").isNull(), F.lit("summary_null")))
    return analysed.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def bug_report_rows(alerts: DataFrame) -> DataFrame:
    """Q13: a bug alert becomes a ``bug_reports`` row; ``created_at`` in
    Unix seconds of the alert's time."""
    return alerts.filter(F.col("category") == "bug").select(
        F.col("id"),
        F.concat(F.lit(OWN_ENTRY_PREFIX + " "), F.col("summary")).alias("subject"),
        F.concat(F.lit("Original Message ID: "), F.col("message_id"),
                 F.lit("\nRecommendation: "), F.coalesce(F.col("recommendation"), F.lit("undefined")))
        .alias("description"),
        F.coalesce(blank_to_null(F.col("severity")), F.lit("medium")).alias("severity"),
        F.lit("open").alias("status"),
        F.unix_seconds(F.col("timestamp")).alias("created_at"),
    )


def feature_suggestion_rows(alerts: DataFrame) -> DataFrame:
    """Q13: a feature_request alert becomes a ``feature_suggestions`` row."""
    iso = iso_text(F.col("timestamp"))
    return alerts.filter(F.col("category") == "feature_request").select(
        F.col("id"),
        F.concat(F.lit(OWN_ENTRY_PREFIX + " "), F.col("summary")).alias("title"),
        F.concat(F.lit("Original Message ID: "), F.col("message_id")).alias("description"),
        F.col("recommendation").alias("useCase"),
        F.lit("medium").alias("priority"),
        F.lit("open").alias("status"),
        iso.alias("createdAt"),
        iso.alias("updatedAt"),
    )


def support_ticket_rows(alerts: DataFrame, messages: DataFrame, texts: LinkedTexts | None = None) -> DataFrame:
    """Q22: bug and complaint alerts become support tickets holding the
    original message."""
    held = [] if texts and "summary" in texts.of_alerts else ["summary"]
    a = alerts.filter(F.col("category").isin("bug", "complaint")) \
        .select(F.col("id").alias("alert_id"), *alert_keys(alerts), *held, "category", "severity")
    return ticket_columns(join_messages(a, messages, ["content", "author_name", "message_url"], texts=texts))


def ticket_columns(alerts: DataFrame) -> DataFrame:
    """Tickets of those alerts, already with their messages, that are bugs or complaints."""
    return alerts.filter(F.col("category").isin("bug", "complaint")).select(
        "alert_id",
        F.col("summary").alias("title"),
        F.col("content").alias("description"),
        "category", "severity",
        F.col("author_name").alias("reported_by"),
        F.col("message_url").alias("message_link"),
    )


def apply_template(alerts: DataFrame, template: str | dict) -> DataFrame:
    """Q28: keep alerts of the template's categories whose severity reaches
    ``minSeverity`` (a NULL severity fails only when a minimum is set), and
    route each to the template's channel; a NULL / missing channel
    suppresses the alert."""
    t = CONFIG_TEMPLATES[template] if isinstance(template, str) else template
    rank_map = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    chan_items = [(k, v) for k, v in t["alertChannels"].items() if v is not None]
    out = alerts.filter(F.col("category").isin(list(t["categories"])))
    if t.get("minSeverity"):
        out = out.filter(F.try_element_at(rank_map, F.col("severity"))
                         >= F.lit(SEVERITY_RANK[t["minSeverity"]]))
    if not chan_items:
        return out.withColumn("target_channel", F.lit(None).cast("string")).limit(0)
    chan_map = F.create_map(*[x for k, v in chan_items for x in (F.lit(k), F.lit(v))])
    return (out.withColumn("target_channel", F.try_element_at(chan_map, F.col("category")))
            .filter(F.col("target_channel").isNotNull()))


def latest_resolutions(resolutions: DataFrame) -> DataFrame:
    """One resolution per message_id: the latest (ties: larger note).
    An aggregation, so a message resolved many times is combined map-side."""
    return (resolutions.groupBy("message_id")
            .agg(F.max_by(F.struct("note", "resolved_at"),
                          F.struct("resolved_at", "note")).alias("r"))
            .select("message_id", F.col("r.note").alias("resolution_note"),
                    F.col("r.resolved_at").alias("resolved_at")))


def resolve_alerts(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Q25: every alert of a resolved message gets ``resolved = true``, the
    note and the time; other alerts keep their values (NULL if absent)."""
    latest = latest_resolutions(resolutions)
    base = alerts
    for c, t in (("resolved", "boolean"), ("resolution_note", "string"), ("resolved_at", "timestamp")):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast(t))
    j = base.join(latest.select("message_id", F.col("resolution_note").alias("_note"),
                                F.col("resolved_at").alias("_at")), "message_id", "left")
    hit = F.col("_at").isNotNull() | F.col("_note").isNotNull()
    cols = [c for c in base.columns]
    return j.select(*[
        (F.when(hit, F.lit(True)).otherwise(F.col("resolved")).alias(c) if c == "resolved" else
         F.when(hit, F.col("_note")).otherwise(F.col(c)).alias(c) if c == "resolution_note" else
         F.when(hit, F.col("_at")).otherwise(F.col(c)).alias(c) if c == "resolved_at" else
         F.col(c))
        for c in cols])


def resolve_stored(alerts: DataFrame) -> DataFrame:
    """Stored alerts (with resolution columns) that carry their message's new resolution
    (``_note``, ``_at``; NULL without one), after it; a stored one that is later stays."""
    hit = F.col("_at").isNotNull() & (F.col("resolved_at").isNull() | (F.col("resolved_at") <= F.col("_at")))
    changed = {"resolved": F.lit(True), "resolution_note": F.col("_note"), "resolved_at": F.col("_at")}
    return alerts.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in alerts.columns if c not in ("_note", "_at")])
