"""What the three slash commands show (Q18-Q20), as DataFrames.

Each view slices a report with ``limit`` before anything reaches the
driver, and folds the few remaining rows into reply text with ordered
``listagg``; the folded row count is bounded by the slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions.columns import js_or, upper_words
from chorus.operators.analytics import daily_report, newest_alerts, search_alerts
from chorus.operators.joins import LinkedTexts
from chorus.schemas import DEFAULT_COLOR, DEFAULT_HOURS, SEVERITY_COLORS

RECENT_VIEW_LIMIT = 10
SEARCH_VIEW_LINES = 5
STATS_VIEW_LINES = 10


def recent_alerts_view(alerts: DataFrame, messages: DataFrame, hours: int | None = None,
                       as_of=None) -> DataFrame:
    """Q18: the first 10 recent alerts as embed rows. ``hours`` 0 / None
    means 24; the message preview always ends with '...'."""
    h = hours or DEFAULT_HOURS
    top = newest_alerts(alerts, messages, RECENT_VIEW_LIMIT, hours=h, as_of=as_of)
    return top.select(
        F.col("id").alias("alert_id"),
        upper_words(F.col("category")).alias("title"),
        F.col("summary").alias("description"),
        js_or(F.col("author_name"), "Unknown").alias("author"),
        js_or(F.col("severity"), "N/A").alias("severity"),
        F.concat(F.substring(F.col("content"), 1, 100), F.lit("...")).alias("message"),
        F.when(F.col("severity") == "critical", F.lit(SEVERITY_COLORS["critical"]))
        .otherwise(F.lit(DEFAULT_COLOR)).alias("color"),
        F.col("timestamp"),
    )


def recent_alerts_reply(alerts: DataFrame, messages: DataFrame, hours: int | None = None,
                        as_of=None) -> DataFrame:
    """Q18 empty case: one row of text when there is nothing to show."""
    h = hours or DEFAULT_HOURS
    view = recent_alerts_view(alerts, messages, hours, as_of)
    spark = alerts.sparkSession
    return spark.range(1).filter(~view.exists()).select(
        F.lit(f"No alerts found in the last {h} hours.").alias("reply"))


def search_view(alerts: DataFrame, messages: DataFrame, query: str, category: str | None = None,
                texts: LinkedTexts | None = None) -> DataFrame:
    """Q19: result count (capped by the search's LIMIT 100) and the first 5
    results as numbered ``i. **category** - summary`` lines."""
    res = search_alerts(alerts, messages, query, category=category, texts=texts)
    ranked = res.select("category", "summary", F.row_number().over(
        Window.orderBy(F.col("timestamp").desc(), F.col("id").desc())).alias("rn"))
    out = ranked.agg(
        F.count(F.lit(1)).alias("found"),
        F.expr(f"listagg(CASE WHEN rn <= {SEARCH_VIEW_LINES} THEN "
               "concat(CAST(rn AS STRING), '. **', category, '** - ', summary) END, '\\n') "
               "WITHIN GROUP (ORDER BY rn)").alias("description"),
    )
    return out.select(
        F.concat(F.lit("Search Results ("), F.col("found").cast("string"), F.lit(" found)")).alias("title"),
        F.when(F.col("found") == 0, F.lit("No results found for your search."))
        .otherwise(F.col("description")).alias("description"),
        "found")


def stats_view(alerts: DataFrame, messages: DataFrame, as_of=None) -> DataFrame:
    """Q20: the daily report's first 10 groups as ``**category**: n alerts``
    lines, or ``No data available``."""
    rep = daily_report(alerts, messages, as_of=as_of).limit(STATS_VIEW_LINES)
    ranked = rep.select("category", "count", F.row_number().over(
        Window.orderBy(F.col("date").desc(), F.col("count").desc(), F.col("category"))).alias("rn"))
    out = ranked.agg(F.count(F.lit(1)).alias("n"), F.expr(
        "listagg(concat('**', category, '**: ', CAST(count AS STRING), ' alerts'), '\\n') "
        "WITHIN GROUP (ORDER BY rn)").alias("lines"))
    return out.select(F.when(F.col("n") == 0, F.lit("No data available")).otherwise(F.col("lines"))
                      .alias("description"))
