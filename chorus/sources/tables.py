"""Readers for the driver's parquet tables and for stored chorus tables."""

from __future__ import annotations

import hashlib
import os
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chorus.session import configure

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def file_version(spark: SparkSession, path: str) -> tuple[str, int, int] | None:
    """(qualified path, modification time, length) of the single file at
    ``path`` (one metadata call to the cluster's file system).

    None for a directory: its modification time does not change when a file
    lands in an existing sub-folder, so it cannot identify a version and
    nothing keyed on it may be reused. None too where the JVM file system is
    not reachable (e.g. a Spark Connect session)."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        st = fs.getFileStatus(p)
        if not st.isFile():
            return None
        return (str(fs.makeQualified(p).toString()), int(st.getModificationTime()), int(st.getLen()))
    except Exception:
        return None


def table_version(spark: SparkSession, path: str) -> tuple | None:
    """:func:`file_version` of a file; of a folder, a digest of the names, modification times and
    lengths of all files under it (one listing). None where neither can be read."""
    version = file_version(spark, path)
    if version is not None:
        return version
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found, files = [], fs.listFiles(p, True)
        while files.hasNext():
            st = files.next()
            found.append((str(st.getPath().toString()), int(st.getModificationTime()), int(st.getLen())))
        return (str(fs.makeQualified(p).toString()), len(found), hashlib.sha256(repr(sorted(found)).encode()).hexdigest())
    except Exception:
        return None


# Scans of the given tables, per session and file version. A DataFrame is a
# lazy plan, so reusing one costs nothing at run time; it saves the file
# listing and footer reads of a new ``spark.read`` for every query. A new
# version of a file (another modification time or length) gets a new scan.
_SCANS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one of the given parquet tables. Column pruning and predicate
    pushdown happen at this scan once the operator's plan is analysed."""
    configure(spark)
    path = table_path(sf_dir, name)
    version = file_version(spark, path)
    if version is None:
        return spark.read.parquet(path)
    scans = _SCANS.setdefault(spark, {})
    df = scans.get(version)
    if df is None:
        df = scans[version] = spark.read.parquet(path)
    return df


def read_stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a stored table (parquet directory, usually partitioned by ``dt``)."""
    configure(spark)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)
