"""Table schemas and the fixed values the operators must share with the
reference's behaviour.

All tables are explicit ``StructType`` constants; nothing is inferred from
JSON or CSV.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for right results).
# Categories and severities the classifier may return, in prompt order.
CATEGORIES = ["bug", "feature_request", "complaint", "praise", "documentation", "other"]
SEVERITIES = ["critical", "high", "medium", "low"]
# Severity rank used by configuration templates (higher = more severe).
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
# Embed colours by severity, and the default colour.
SEVERITY_COLORS = {"critical": 0xFF0000, "high": 0xFF6600, "medium": 0xFFCC00, "low": 0x00CC00}
DEFAULT_COLOR = 0x3498DB
# Embed emoji by category, and the default emoji.
CATEGORY_EMOJIS = {
    "bug": "🐛",
    "feature_request": "✨",
    "complaint": "⚠️",
    "praise": "👍",
    "documentation": "📚",
    "other": "💬",
}
DEFAULT_EMOJI = "💬"
# Routing targets and text used in notifications.
ALERT_CHANNEL_NAME = "❗║error-handling"
FEATURE_CHANNEL_NAME = "⚙️║feature-suggestions"
CRITICAL_CHANNEL_NAME = "dev-critical-alerts"
OWN_ENTRY_PREFIX = "[Discord]"
ALERT_FOOTER = "Automated Feedback Analysis"
MONITOR_FOOTER = "Database Monitor"
BUG_CONFIRMATION = "✅ **System Update**: This 🐛 Bug Report has been automatically logged in the database for the product team."
FEATURE_CONFIRMATION = "✅ **System Update**: This 💡 Feature Suggestion has been automatically logged in the database for the product team."
CRITICAL_BUG_TEXT = "@here CRITICAL BUG REPORTED"
FEATURE_NOTICE_PREFIX = "New feature request: "
RESOLVED_NOTICE_PREFIX = "✅ Your feedback has been addressed: "
ISSUE_LABELS = ["bug", "discord-feedback"]
ISSUE_BODY_FORMAT = "```\nOriginal Message: %s\nReported by: %s\nDiscord Link: %s\n```"
# Fallback analysis when a model response holds no JSON object.
FALLBACK_CATEGORY = "other"
FALLBACK_SUMMARY = "Analysis inconclusive"
FALLBACK_RECOMMENDATION = "Review manually"
# Defaults of the relevance filter and look-backs.
MIN_MESSAGE_LENGTH = 5
DEFAULT_HOURS = 24
SEARCH_LIMIT = 100
BACKLOG_LIMIT = 100
POLL_INTERVAL = "30 seconds"
# Configuration templates: categories, minimum severity, channel per category.
CONFIG_TEMPLATES = {
    "BUG_TRACKING": {
        "categories": ["bug"],
        "minSeverity": "medium",
        "alertChannels": {"bug": "critical-bugs", "feature_request": None, "complaint": None},
    },
    "PRODUCT_FEEDBACK": {
        "categories": ["feature_request", "praise"],
        "minSeverity": None,
        "alertChannels": {"feature_request": "feature-ideas", "praise": "wins", "bug": None},
    },
    "FULL_FEEDBACK": {
        "categories": ["bug", "feature_request", "complaint", "praise", "documentation"],
        "minSeverity": None,
        "alertChannels": {
            "bug": "bugs",
            "feature_request": "feature-requests",
            "complaint": "complaints",
            "praise": "praise",
            "documentation": "docs",
        },
    },
}
# ---------------------------------------------------------------------------


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


S, L, TS, B, D = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType(), T.DoubleType()
DATE = T.DateType()

MESSAGES = T.StructType([
    _f("id", L, False),
    _f("message_id", S, False),
    _f("channel_id", S, False),
    _f("channel_name", S, False),
    _f("author_id", S, False),
    _f("author_name", S, False),
    _f("content", S, False),
    _f("timestamp", TS, False),
    _f("message_url", S),
    _f("created_at", TS),
])

ALERTS = T.StructType([
    _f("id", L, False),
    _f("message_id", S, False),
    _f("category", S, False),
    _f("severity", S),
    _f("summary", S, False),
    _f("recommendation", S),
    _f("timestamp", TS, False),
    _f("created_at", TS),
])

ALERT_RESOLUTION = T.StructType([
    _f("resolved", B),
    _f("resolution_note", S),
    _f("resolved_at", TS),
])

BUG_REPORTS = T.StructType([
    _f("id", L, False),
    _f("subject", S),
    _f("description", S),
    _f("severity", S),
    _f("status", S),
    _f("created_at", L),  # Unix seconds
])

FEATURE_SUGGESTIONS = T.StructType([
    _f("id", L, False),
    _f("title", S),
    _f("description", S),
    _f("useCase", S),
    _f("priority", S),
    _f("status", S),
    _f("createdAt", S),  # ISO-8601 text
    _f("updatedAt", S),
])

SUPPORT_TICKETS = T.StructType([
    _f("alert_id", L, False),
    _f("title", S),
    _f("description", S),
    _f("category", S),
    _f("severity", S),
    _f("reported_by", S),
    _f("message_link", S),
])

ATTACHMENT = T.StructType([_f("name", S), _f("url", S), _f("contentType", S)])

MESSAGE_EVENTS = T.StructType([
    _f("id", S, False),
    _f("channel_id", S),
    _f("channel_name", S),
    _f("author_id", S),
    _f("author_name", S),
    _f("author_bot", B),
    _f("guild_name", S),
    _f("content", S),
    _f("created_ms", L),
    _f("url", S),
    _f("attachments", T.ArrayType(ATTACHMENT)),
])

MODEL_RESPONSES = T.StructType([_f("message_id", S, False), _f("response", S)])

ANALYSIS = T.StructType([
    _f("requiresAlert", B),
    _f("category", S),
    _f("severity", S),
    _f("summary", S),
    _f("recommendation", S),
])

CHANNELS = T.StructType([_f("name", S, False), _f("type", S, False)])

RESOLUTIONS = T.StructType([_f("message_id", S, False), _f("note", S), _f("resolved_at", TS)])

EMBED_FIELD = T.StructType([_f("name", S, False), _f("value", S), _f("inline", B, False)])

NOTIFICATIONS = T.StructType([
    _f("source", S, False),        # 'alert' | 'monitor' | 'notice'
    _f("source_id", L, False),     # alert id / table row id
    _f("seq", T.IntegerType(), False),
    _f("target_channel", S),
    _f("recipient", S),
    _f("content", S),
    _f("embed_json", S),
    _f("files", T.ArrayType(S)),
])

# Stored shapes: what the tables keep beside the reference's columns.

# A message's folder is the UTC date of its time, which never changes.
STORED_MESSAGES = T.StructType([*MESSAGES.fields, _f("dt", DATE, False)])
# An alert keeps its message's date, and its resolution.
STORED_ALERTS = T.StructType([*ALERTS.fields, _f("message_dt", DATE), *ALERT_RESOLUTION.fields])
# What is to be delivered outside, and what became of it.
OUTBOX = T.StructType([
    _f("delivery_key", S, False),
    _f("kind", S, False),          # 'alert' | 'external' | 'critical' | 'feature' | 'ticket' | 'issue' | 'resolution'
    _f("source_id", S, False),     # the id, within the kind, of what it is about
    _f("seq", T.IntegerType(), False),
    _f("target_channel", S),
    _f("recipient", S),
    _f("content", S),
    _f("payload_json", S),
    _f("files", T.ArrayType(S)),
    _f("created_at", TS),
])
OUTBOX_ATTEMPTS = T.StructType([
    _f("delivery_key", S, False),
    _f("attempt", T.IntegerType(), False),
    _f("status", S, False),        # 'sent' | 'failed'
    _f("error", S),
    _f("attempted_at", TS, False),
])
