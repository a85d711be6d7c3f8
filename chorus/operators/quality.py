"""Schema constraints of the stored tables as check jobs (Q29).

The reference declares NOT NULL, UNIQUE and a foreign key in its DDL; a
parquet table enforces none of them, so each becomes a count. :func:`validate`
counts every rule in one pass per table (per-key aggregates, then one join of
the two); offending keys come from :func:`violations`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.schemas import ALERTS, CATEGORIES, MESSAGES, SEVERITIES


def _not_null_cols(schema) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]


def violations(messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per offending key: (table, rule, key)."""
    parts = []
    for table, df, schema, key in (("messages", messages, MESSAGES, "message_id"),
                                   ("alerts", alerts, ALERTS, "id")):
        for c in _not_null_cols(schema):
            if c in df.columns:
                parts.append(df.filter(F.col(c).isNull()).select(
                    F.lit(table).alias("table"), F.lit(f"not_null:{c}").alias("rule"),
                    F.col(key).cast("string").alias("key")))
    dup = (messages.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > 1)
           .select(F.lit("messages").alias("table"), F.lit("unique:message_id").alias("rule"),
                   F.col("message_id").alias("key")))
    orphans = (alerts.select("id", "message_id").join(messages.select("message_id"), "message_id", "left_anti")
               .select(F.lit("alerts").alias("table"), F.lit("foreign_key:message_id").alias("rule"),
                       F.col("id").cast("string").alias("key")))
    bad_cat = (alerts.filter(~F.col("category").isin(CATEGORIES))
               .select(F.lit("alerts").alias("table"), F.lit("domain:category").alias("rule"),
                       F.col("id").cast("string").alias("key")))
    bad_sev = (alerts.filter(F.col("severity").isNotNull() & ~F.col("severity").isin(SEVERITIES))
               .select(F.lit("alerts").alias("table"), F.lit("domain:severity").alias("rule"),
                       F.col("id").cast("string").alias("key")))
    out = dup.unionByName(orphans).unionByName(bad_cat).unionByName(bad_sev)
    for p in parts:
        out = out.unionByName(p)
    return out


def validate(messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """Q29: (table, rule, violations) for every rule, zero included.

    One pass per table: each table is aggregated per ``message_id`` with its
    NOT NULL and domain counts (partial aggregation, so a hot key collapses
    map-side); the two per-key aggregates (unique keys on both sides) are
    joined, and one global aggregation yields every rule: UNIQUE = keys with
    more than one message, FOREIGN KEY = alerts whose key has no message (a
    NULL key never matches). Offending keys come from :func:`violations`.
    """
    m_checks = [(f"not_null:{c}", F.col(c).isNull()) for c in _not_null_cols(MESSAGES) if c in messages.columns]
    a_checks = [(f"not_null:{c}", F.col(c).isNull()) for c in _not_null_cols(ALERTS) if c in alerts.columns]
    a_checks += [("domain:category", ~F.col("category").isin(CATEGORIES)),
                 ("domain:severity", F.col("severity").isNotNull() & ~F.col("severity").isin(SEVERITIES))]
    m_agg = messages.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("_m_n"), *[F.count_if(c).alias(f"_m{i}") for i, (_, c) in enumerate(m_checks)])
    a_agg = alerts.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("_a_n"), *[F.count_if(c).alias(f"_a{i}") for i, (_, c) in enumerate(a_checks)])
    joined = a_agg.join(m_agg, "message_id", "full_outer")

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    totals = joined.agg(
        *[total(f"_m{i}").alias(f"_m{i}") for i in range(len(m_checks))],
        *[total(f"_a{i}").alias(f"_a{i}") for i in range(len(a_checks))],
        F.count_if(F.col("_m_n") > 1).cast("long").alias("_dup"),
        total(F.when(F.col("_m_n").isNull(), F.col("_a_n"))).alias("_orphans"))
    rows = ([("messages", rule, f"_m{i}") for i, (rule, _) in enumerate(m_checks)]
            + [("alerts", rule, f"_a{i}") for i, (rule, _) in enumerate(a_checks)]
            + [("messages", "unique:message_id", "_dup"), ("alerts", "foreign_key:message_id", "_orphans")])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("table"), F.lit(r).alias("rule"), F.col(c).alias("violations"))
        for t, r, c in rows])))
