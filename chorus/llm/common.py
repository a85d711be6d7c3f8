"""Shared by the operators: reading inputs, intermediate tables, packed arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark (any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 texts between Spark and Python, where the session still
    has the default of 10,000: their buffers are what executors hold per task."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): null texts become empty, other columns go."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(modulus: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo: the split of every learning operator."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("long").cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Set here only where it is unset on a local master, as in tests; a cluster
    without the setting is an error, not a reason to use a local disk."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="chorus-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark)}/chorus-llm/{name}-{uuid.uuid4().hex[:12]}"


_stored: list[str] = []


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there,
    so a lost executor costs no recomputation of what came before."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if not lasting:
        _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that stored() has written so far and not marked lasting:
    for callers that have written all results which read them."""
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_stored() -> None:
    """Leave the tables stored so far alone: drop_stored() deletes later ones only."""
    _stored.clear()


# Packed arrays: byte planes under zstd, for sorted keys as differences.

def _planes(values: np.ndarray) -> bytes:
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _values(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted 64-bit keys and columns of the same length, as bytes."""
    keys = keys.astype(np.uint64)
    parts = [_planes(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys), *(_planes(c.astype(np.int64).view(np.uint64)) for c in columns)]
    head = np.array([len(keys), len(parts), *(len(p) for p in parts)], "<u8").tobytes()
    return head + b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    """What pack() was given: uint64 keys, then int64 columns."""
    n, k = (int(x) for x in np.frombuffer(blob[:16], "<u8"))
    sizes = np.frombuffer(blob[16 : 16 + 8 * k], "<u8").astype(int)
    at, out = 16 + 8 * k, []
    for size in sizes:
        out.append(_values(blob[at : at + size], n))
        at += size
    return [np.cumsum(out[0], dtype=np.uint64), *(c.view(np.int64) for c in out[1:])]


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all lists with their summed counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterable[dict]:
    """Rows one at a time, for rows that hold packed arrays: no copy of a whole batch."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def slice_rows(b: pa.RecordBatch, most_bytes: int = 2 << 20) -> Iterable[pa.RecordBatch]:
    """Parts of a batch with about most_bytes of text each, one row at least."""
    from chorus.llm.tokens import slices

    for start, end in slices(b.column("text"), most_bytes):
        yield b.slice(start, end - start)


def sha256_hex(values: Iterable[bytes]) -> list[str]:
    import hashlib

    return [hashlib.sha256(v).hexdigest() for v in values]


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for another file system."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else os.path.abspath(uri)



# Arrays of a model as files in the shared folder, memory-mapped by workers.

def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_array(folder: str, name: str, values: np.ndarray) -> str:
    """Write an array under a name of its own, from a task; returns the file's
    name.  A repeated task writes another file, so its row names a whole one."""
    own = f"{name}-{uuid.uuid4().hex[:12]}"
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{own}") as out:
        out.write(np.ascontiguousarray(values).tobytes())
    return own


def get_array(folder: str, name: str, dtype) -> np.ndarray:
    """The array, memory-mapped: from the shared folder where that is mounted,
    else from a copy that the worker fetches once and can fetch again."""
    path = local_path(folder)
    if path is None:
        path = os.path.join(tempfile.gettempdir(), "chorus-llm-model", os.path.basename(folder))
        if not os.path.exists(f"{path}/{name}"):
            system, source = _file_system(folder)
            os.makedirs(path, exist_ok=True)
            part = f"{path}/{name}.{uuid.uuid4().hex[:8]}"
            with system.open_input_stream(f"{source}/{name}") as src, open(part, "wb") as out:
                while chunk := src.read(1 << 24):
                    out.write(chunk)
            os.replace(part, f"{path}/{name}")
    if not os.path.getsize(f"{path}/{name}"):
        return np.empty(0, dtype)
    return np.memmap(f"{path}/{name}", dtype=dtype, mode="r")
