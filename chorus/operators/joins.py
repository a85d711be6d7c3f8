"""The alerts ⋈ messages join used by most reports.

Stored tables are partitioned by date. When the alert rows also carry
their message's date (``message_dt``, written by the flow and by
``sources.stored``), the join matches the dates too. A message's date is
fixed, so the result is the same, but Spark can now prune the messages
table to the dates the selected alerts point at (dynamic partition
pruning) instead of scanning every message's text for a look-back query.

Where a table's long texts come from another table (the derived tables: a message
is a document), the two can be given without them (``LinkedTexts``): keys and short
columns are joined, and each row that is left gets its texts afterwards, so no text
travels once per side and row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_LINK = "message_dt"


@dataclass(frozen=True)
class LinkedTexts:
    """Columns that joined rows get last: ``attach`` adds them, by the messages' ``links``."""

    links: tuple[str, ...]
    attach: Callable[[DataFrame], DataFrame]
    of_alerts: tuple[str, ...] = ("summary",)


def alert_keys(alerts: DataFrame) -> list[str]:
    """Columns that identify an alert's message (with its date if stored)."""
    return ["message_id"] + ([DATE_LINK] if DATE_LINK in alerts.columns else [])


def join_messages(alerts: DataFrame, messages: DataFrame, cols: Sequence[str], how: str = "inner",
                  texts: LinkedTexts | None = None) -> DataFrame:
    """``alerts`` joined to ``messages`` on message_id, bringing ``cols``; with ``texts``, those
    that the tables lack come from there."""
    if texts is not None:
        have = [c for c in cols if c in messages.columns]
        j = join_messages(alerts, messages, [*have, *texts.links], how)
        return texts.attach(j).select(*alerts.columns, *texts.of_alerts, *cols)
    if DATE_LINK in alerts.columns and "dt" in messages.columns:
        m = messages.select("message_id", F.col("dt").alias(DATE_LINK), *cols)
        return alerts.join(m, ["message_id", DATE_LINK], how)
    return alerts.join(messages.select("message_id", *cols), "message_id", how)


def message_dates_since(alerts: DataFrame, cutoff: Column) -> DataFrame:
    """Keep alerts whose message can be newer than ``cutoff`` (needs the
    stored ``message_dt``; otherwise a no-op)."""
    if DATE_LINK in alerts.columns:
        return alerts.filter(F.col(DATE_LINK) >= F.to_date(cutoff))
    return alerts
