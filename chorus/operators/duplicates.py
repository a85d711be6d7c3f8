"""Duplicate bug detection (Q8).

The reference asks a language model which recent bug summaries resemble a
new one. Re-aimed as token-set Jaccard similarity with native array
functions: tokens are ``split(lower(text), '\\W+')`` without empties,
deduplicated. Scoring one new summary against all candidates is a single
projection (no join, no pairs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.operators.analytics import recent
from chorus.operators.joins import join_messages


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays of distinct tokens; NULL when both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common.cast("double") / union.cast("double"))


def bug_candidates(alerts: DataFrame, messages: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """Bug alerts of the last ``days`` joined to their message content."""
    a = recent(alerts.filter(F.col("category") == "bug"), as_of, days=days)
    return join_messages(a, messages, ["content"])


def oldest_summary(candidates: DataFrame) -> Column:
    """Tokens of the candidate with the smallest id, as scalar subqueries: the id is found
    without the texts, and one row's text is read."""
    oldest = candidates.select(F.min("id")).scalar()
    return candidates.filter(F.col("id") == oldest).select(tokens(F.coalesce("summary", F.lit("")))).limit(1).scalar()


def duplicate_bugs(candidates: DataFrame, new_summary: str | Column, threshold: float = 0.5) -> DataFrame:
    """Candidates whose summary has Jaccard >= ``threshold`` with the new summary (a text,
    or a column of its tokens), best first (ties id). Empty result = "none".

    Each candidate is cut into tokens once. Sets whose sizes differ too much cannot reach
    the threshold, so only the others are intersected."""
    new = new_summary if isinstance(new_summary, Column) else tokens(F.lit(new_summary))
    # Always true but not deterministic: keeps the filters on the score from being pushed
    # below these projections, where tokens and score would be evaluated again.
    fence = F.spark_partition_id() >= 0
    cut = candidates.withColumn("_tokens", F.when(fence, tokens(F.col("summary")))).withColumn("_new", F.when(fence, new))
    n, m = F.size("_tokens"), F.size("_new")
    close = F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)
    score = F.when(fence & close, jaccard(F.col("_tokens"), F.col("_new")))
    return (cut.withColumn("score", score).drop("_tokens", "_new")
            .filter(F.col("score") >= F.lit(threshold))
            .orderBy(F.col("score").desc(), F.col("id")))
