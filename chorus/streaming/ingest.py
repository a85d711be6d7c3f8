"""Streaming message ingest (Q11 → Q12 → Q13 → Q14 per micro-batch).

``readStream`` over a folder of message events (JSON lines or parquet with
the ``MESSAGE_EVENTS`` schema) or a Kafka topic → ``foreachBatch`` running
:func:`chorus.plans.feedback_flow.run_feedback_batch`. The engine never
overlaps micro-batches, and a replayed batch is found in the ledger, so
outputs are exactly-once although ``foreachBatch`` is at-least-once.

Besides the event, a source gives ``arrival`` (the order in which copies of a
message count), ``position`` (where the event stands in the source) and
``corrupt`` (the text of a value that is no event; it goes to quarantine with its
position, and its neighbours pass).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chorus.plans.feedback_flow import FlowConfig, run_feedback_batch
from chorus.schemas import MESSAGE_EVENTS
from chorus.sources.ledger import Files

WITH_CORRUPT = T.StructType([*MESSAGE_EVENTS.fields, T.StructField("corrupt", T.StringType())])
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}


# Default micro-batch bounds: a job restarted after a long stop (or started
# on a large backlog) works through it in batches of bounded size instead of
# one batch holding everything. Pass None for no bound.
MAX_FILES_PER_TRIGGER = 1000
MAX_OFFSETS_PER_TRIGGER = 5_000_000


def _with_file_position(events: DataFrame) -> DataFrame:
    """Arrival of file events: the file's time, then its name and the part of it."""
    at = F.col("_metadata")
    arrival = F.struct(at["file_modification_time"].alias("time"), at["file_path"].alias("path"), at["file_block_start"].alias("block"))
    return events.select("*", arrival.alias("arrival"), F.concat(at["file_path"], F.lit(":"), at["file_block_start"].cast("string")).alias("position"))


def read_events(spark: SparkSession, source: str, fmt: str = "json") -> DataFrame:
    """Message events of a folder (or glob) as a batch."""
    return _with_file_position(spark.read.schema(WITH_CORRUPT if fmt == "json" else MESSAGE_EVENTS).format(fmt).options(**_PERMISSIVE).load(source))


def event_stream(spark: SparkSession, source: str, fmt: str = "json",
                 max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """A streaming DataFrame of message events from a folder (or glob)."""
    reader = spark.readStream.schema(WITH_CORRUPT if fmt == "json" else MESSAGE_EVENTS).format(fmt).options(**_PERMISSIVE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _with_file_position(reader.load(source))


def kafka_event_stream(spark: SparkSession, bootstrap_servers: str, topic: str,
                       starting_offsets: str = "latest",
                       max_offsets_per_trigger: int | None = MAX_OFFSETS_PER_TRIGGER) -> DataFrame:
    """Message events from a Kafka topic whose values are event JSON
    (``MESSAGE_EVENTS``). Needs the Spark Kafka connector on the classpath."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    try:
        raw = reader.load()
    except Exception as exc:  # connector missing
        raise RuntimeError("the Kafka source needs the spark-sql-kafka connector package") from exc
    return parse_kafka(raw)


def parse_kafka(raw: DataFrame) -> DataFrame:
    """Events of Kafka records (value, topic, partition, offset, timestamp).

    ``arrival`` is (broker timestamp, partition, offset): offsets only order records inside
    one partition, the timestamp orders copies of a message that landed in different ones."""
    event = F.from_json(F.col("value").cast("string"), WITH_CORRUPT, _PERMISSIVE)
    arrival = F.struct(F.col("timestamp").alias("ts"), "partition", "offset")
    position = F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return raw.select(event.alias("e"), arrival.alias("arrival"), position.alias("position")).select("e.*", "arrival", "position")


def writer_of(spark: SparkSession, checkpoint: str, kind: str) -> str:
    """The ledger's name for the stream of a checkpoint: made at its first start, and so
    another one for a new checkpoint, whose batches count from 0 again."""
    files, path = Files(spark), f"{checkpoint.rstrip('/')}/_writer"
    name = files.read(path)
    if not name:
        name = f"{kind}-{uuid.uuid4().hex}"
        files.write(path, name)
    return name


def start_ingest(spark: SparkSession, events: DataFrame, root: str, checkpoint: str,
                 cfg: FlowConfig, trigger: str | None = "10 seconds",
                 available_now: bool = False) -> StreamingQuery:
    """Start the stream; its tables are those of the feedback ledger at ``root``."""
    writer_id = writer_of(spark, checkpoint, "ingest")

    def run(batch: DataFrame, epoch_id: int) -> None:
        run_feedback_batch(spark, batch, root, cfg, epoch_id, writer_id)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
