"""Session helpers: one place for the settings every operator relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

UTC = "UTC"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume.

    The reference evaluates DATE()/datetime('now') in UTC, so the session
    zone is pinned to UTC. AQE stays on so joins and aggregations are
    re-planned from runtime sizes (broadcast only when the measured side is
    below ``spark.sql.autoBroadcastJoinThreshold``, skewed partitions split).
    """
    conf = spark.conf
    if conf.get("spark.sql.session.timeZone", None) != UTC:
        conf.set("spark.sql.session.timeZone", UTC)
    for key, value in (
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        # Look-back reports join recent alerts to the date-partitioned
        # messages table on (message_id, date). Let dynamic partition pruning
        # run even when the alert side is too big to broadcast: evaluating
        # the filtered alerts once more is far cheaper than scanning every
        # date of message text.
        ("spark.sql.optimizer.dynamicPartitionPruning.reuseBroadcastOnly", "false"),
    ):
        if conf.get(key, None) != value:
            conf.set(key, value)
    return spark


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """While this lasts, a statement's shuffle files go when it has ended. Spark keeps them until the
    driver collects its garbage, for statements that run the same DataFrame again; a body whose
    steps write their rows and read them back has no use for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def get_session(app_name: str = "chorus", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster, call without ``master`` and let spark-submit decide; the
    shuffle partition count should then come from the cluster profile.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Do not capture the Python call site on every Column function call
        # (several JVM round trips each): it only decorates error messages,
        # and operators build plans of hundreds of expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system set by the cluster; it is
    only filled in here when unset (local runs and tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        # Unset: a local run or a test. A cluster has to name a shared folder.
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="chorus-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
