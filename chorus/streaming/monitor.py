"""External-entry monitor (Q16): new rows of ``bug_reports`` /
``feature_suggestions`` written by other tools become notifications.

Batch form: :func:`new_external_entries` (rows with ``id > mark`` whose
subject/title does not carry the own-entry prefix, ``id`` ascending) and
:func:`start_mark` (``MAX(id)`` or 0).

Streaming form: :func:`start_monitor` runs one Structured Streaming query
per table over the table's parquet folder, with a 30-second trigger. The
high-water mark of the reference lives in process memory and loses rows
that arrive while the process is down, or with an id below the mark. Here
what counts is what was seen: the files that exist at the first start are
written down and skipped, the file source's checkpoint remembers those read
since, and a row is notified once, whatever its id and however often other
tools write it again, because its delivery key is unique in the outbox.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chorus.operators.outbox import external_deliveries
from chorus.operators.payload import route_external
from chorus.operators.sinks import is_missing, read_if_exists
from chorus.schemas import BUG_REPORTS, FEATURE_SUGGESTIONS, OWN_ENTRY_PREFIX, POLL_INTERVAL
from chorus.sources.feedback import feedback_ledger
from chorus.streaming.ingest import writer_of

TITLE_COLUMN = {"bug": "subject", "feature": "title"}
SCHEMA = {"bug": BUG_REPORTS, "feature": FEATURE_SUGGESTIONS}


def start_mark(table: DataFrame) -> Column:
    """``MAX(id)`` of a table, 0 when empty, as a scalar subquery column."""
    return table.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()


def not_own_entry(title: Column) -> Column:
    """Rows written by the alert router carry the own-entry prefix; a NULL
    title counts as not prefixed."""
    return ~F.coalesce(title.startswith(OWN_ENTRY_PREFIX), F.lit(False))


def new_external_entries(table: DataFrame, kind: str, mark=0) -> DataFrame:
    """Rows above ``mark`` that other tools wrote, ``id`` ascending."""
    m = mark if isinstance(mark, Column) else F.lit(int(mark))
    return (table.filter((F.col("id") > m) & not_own_entry(F.col(TITLE_COLUMN[kind])))
            .orderBy("id"))


def external_notifications(table: DataFrame, kind: str, mark=0) -> DataFrame:
    """Q16 end to end (batch): new external rows → notification rows."""
    return route_external(new_external_entries(table, kind, mark), kind)


SEEN = "path string"


def files_at_start(spark: SparkSession, table_path: str, seen_path: str, skip_existing: bool) -> DataFrame:
    """The files to skip: those that existed at the first start, written down then (none
    with ``skip_existing=False``). Spark writes and reads the list, so it lives on the
    checkpoint's file system and its length does not matter."""
    seen = read_if_exists(spark, seen_path, SEEN)
    if seen is not None:
        return seen
    found = spark.createDataFrame([], SEEN)
    if skip_existing:
        try:
            found = spark.read.parquet(table_path).select(F.col("_metadata.file_path").alias("path")).distinct()
        except AnalysisException as error:  # table not created yet
            if not is_missing(error):
                raise
    found.write.mode("overwrite").parquet(seen_path)
    return spark.read.schema(SEEN).parquet(seen_path)


def start_monitor(spark: SparkSession, table_path: str, kind: str, root: str, checkpoint: str,
                  trigger: str | None = POLL_INTERVAL, skip_existing: bool = True,
                  available_now: bool = False, as_of=None) -> StreamingQuery:
    """Start one monitor stream for ``kind`` ('bug' or 'feature') over the folder
    ``table_path``; deliveries go to the outbox of the feedback ledger at ``root``."""
    checkpoint = checkpoint.rstrip("/")
    seen = files_at_start(spark, table_path, f"{checkpoint}/_seen", skip_existing)
    writer_id, ledger = writer_of(spark, checkpoint, f"monitor-{kind}"), feedback_ledger(spark, root)
    stream = spark.readStream.schema(SCHEMA[kind]).parquet(table_path).select("*", F.col("_metadata.file_path").alias("path"))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        fresh = batch.filter(not_own_entry(F.col(TITLE_COLUMN[kind]))).join(seen, "path", "left_anti").drop("path")

        def body(tx) -> dict[str, int]:
            tx.append("outbox", external_deliveries(fresh, kind, as_of))
            return {"outbox": tx.rows.get("outbox", 0)}

        ledger.transact(body, writer_id, epoch_id)
        ledger.maintain()

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
