"""Stored feedback tables: how a deployment keeps ``messages`` and
``alerts`` (parquet partitioned by UTC date, sorted by time inside each
file so row-group statistics prune look-backs too)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.schemas import ALERTS, MESSAGES
from chorus.sources import derived as dv


def write_feedback_tables(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """Derive messages / alerts from the given tables and store them."""
    out = {}
    msgs = dv.messages(spark, sf_dir)
    # Alerts also keep their message's date (joins.DATE_LINK) for pruning.
    alerts = dv.alerts(spark, sf_dir).join(
        msgs.select("message_id", F.to_date("timestamp").alias("message_dt")), "message_id")
    for name, df in (("messages", msgs), ("alerts", alerts)):
        path = os.path.join(root, name)
        # Range partitioning on (dt, timestamp): a large date is split over
        # many tasks (hash partitioning by dt would give each date one task),
        # and every file holds a narrow, sorted time range for row-group pruning.
        (df.withColumn("dt", F.to_date("timestamp"))
         .repartitionByRange("dt", "timestamp").sortWithinPartitions("dt", "timestamp")
         .write.mode("overwrite").partitionBy("dt").parquet(path))
        out[name] = path
    return out


def _with_dt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("dt", T.DateType())])


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_with_dt(MESSAGES)).parquet(os.path.join(root, "messages"))


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType(ALERTS.fields + [T.StructField("message_dt", T.DateType())])
    return spark.read.schema(_with_dt(schema)).parquet(os.path.join(root, "alerts"))
