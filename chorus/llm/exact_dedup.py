"""Exact duplicates by counting quotient filters (operator 5).

Each task hashes its texts to 64 bits and builds a counting quotient filter:
the high bits of a fingerprint are its quotient, the rest its remainder; per
quotient the sorted remainders and their counts.  A filter is cut by ranges of
quotients; the parts of one range meet in one task and merge by their sorted
remainders without loss, so the merged filter is that of all texts.
Fingerprints counted more than once go to byte verification: their texts are
grouped by their bytes, and only texts that are equal form a group.

A text in a third of all rows is one entry of each task's filter, and one row
of each task before the grouping by text, so no task gets its copies.

Null counts as the empty text; ``doc_id`` should be unique (the same row twice
counts as two copies and both rows are returned).  An empty table gives an
empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import batch, sha256_hex, slice_rows, stored, texts

QUOTIENT_BITS = 20
#: High bits of the quotient that choose the range in which filters merge.
RANGE_BITS = 8

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string())])
_PARTS = pa.schema([("range", pa.int32()), ("filter", pa.binary())])


class CountingQuotientFilter:
    """Fingerprints with counts, as occupied bits, run ends, remainders, counts.

    Slots are dense: ``occupied`` has a bit per quotient, ``run_end`` a bit per
    slot; the i-th run belongs to the i-th occupied quotient."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int = QUOTIENT_BITS):
        """fingerprints: sorted and distinct, uint64."""
        self.shift = np.uint64(64 - quotient_bits)
        quotient = (fingerprints >> self.shift).astype(np.int64)
        self.occupied = np.zeros(1 << quotient_bits, bool)
        self.occupied[quotient] = True
        self.run_end = np.r_[quotient[1:] != quotient[:-1], True] if len(quotient) else np.empty(0, bool)
        self.remainders = fingerprints & ((np.uint64(1) << self.shift) - np.uint64(1))
        self.counts = counts.astype(np.int64)

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int = QUOTIENT_BITS) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True), quotient_bits)

    def fingerprints(self) -> np.ndarray:
        run = np.cumsum(self.run_end) - self.run_end
        return (np.flatnonzero(self.occupied)[run].astype(np.uint64) << self.shift) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' entries in order of quotient and remainder, counts of equal ones added."""
        mine, theirs = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(mine, theirs)
        same = np.zeros(len(theirs), bool)
        inside = at < len(mine)
        same[inside] = mine[at[inside]] == theirs[inside]
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        new = ~same
        return CountingQuotientFilter(np.insert(mine, at[new], theirs[new]), np.insert(counts, at[new], other.counts[new]), 64 - int(self.shift))

    def ranges(self, range_bits: int = RANGE_BITS) -> Iterator[tuple[int, bytes]]:
        """The filter cut by the high bits of the quotient, as bytes."""
        whole = self.fingerprints()
        cut = np.searchsorted(whole >> np.uint64(64 - range_bits), np.arange((1 << range_bits) + 1, dtype=np.uint64))
        bits = 64 - int(self.shift)
        for r in range(1 << range_bits):
            a, b = cut[r], cut[r + 1]
            if b > a:
                low = r << (bits - range_bits)
                yield r, b"".join((np.array([bits, low, b - a], "<i8").tobytes(), np.packbits(self.occupied[low : low + (1 << (bits - range_bits))]).tobytes(), np.packbits(self.run_end[a:b]).tobytes(), self.remainders[a:b].tobytes(), self.counts[a:b].astype("<i8").tobytes()))

    @classmethod
    def part(cls, data: bytes, range_bits: int = RANGE_BITS) -> CountingQuotientFilter:
        """A range read back from bytes."""
        bits, low, n = (int(x) for x in np.frombuffer(data[:24], "<i8"))
        width, at = 1 << (bits - range_bits), 24
        out = cls(np.empty(0, np.uint64), np.empty(0, np.int64), bits)
        out.occupied[low : low + width] = np.unpackbits(np.frombuffer(data, np.uint8, (width + 7) // 8, at))[:width].astype(bool)
        at += (width + 7) // 8
        out.run_end = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at))[:n].astype(bool)
        at += (n + 7) // 8
        out.remainders = np.frombuffer(data, "<u8", n, at).astype(np.uint64)
        out.counts = np.frombuffer(data, "<i8", n, at + 8 * n).astype(np.int64)
        return out


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slice_rows(b):
            data = [t.as_py().encode() for t in part.column("text")]
            fp = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in data), np.uint64, len(data))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(sha256_hex(data))], schema=_PRINTS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_sha256) of every row; one pass over the texts."""
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long, text_sha256 string")


def _partition_filter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One counting quotient filter of the partition, cut by range."""
    held: CountingQuotientFilter | None = None
    for b in batches:
        new = CountingQuotientFilter.build(b.column("fp").to_numpy().view(np.uint64))
        held = new if held is None else held.merge(new)
    if held is not None and len(held.counts):
        ranges = list(held.ranges())
        yield batch(_PARTS, range=[r for r, _ in ranges], filter=[x for _, x in ranges])


def _merged_repeats(parts: pa.Table) -> pa.Table:
    """Merge a range's filters, two at a time; the fingerprints counted more than once."""
    held = [CountingQuotientFilter.part(x.as_py()) for x in parts.column("filter")]
    while len(held) > 1:
        held = [a.merge(b) for a, b in zip(held[::2], held[1::2], strict=False)] + held[len(held) // 2 * 2 :]
    fp = held[0].fingerprints()[held[0].counts > 1]
    return pa.table({"fp": pa.array(fp.view(np.int64))})


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp) of the merged filter's entries with a count above one."""
    parts = prints.select("fp").mapInArrow(_partition_filter, "range int, filter binary")
    return parts.groupBy("range").applyInArrow(_merged_repeats, "fp long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of docs as (doc_id, keep_id, group_size, kept, text_sha256).

    Of equal texts the largest doc_id stays."""
    prints = stored(fingerprints(docs), "exact-prints")
    repeats = stored(repeated_fingerprints(prints), "exact-repeats")
    suspects = prints.join(repeats, "fp").select(F.col("doc_id").alias("s_id"), F.col("fp").alias("g_fp"), F.col("text_sha256").alias("g_sha")).distinct()
    bodies = texts(docs).join(suspects, (F.col("doc_id") == F.col("s_id")) & (F.sha2("text", 256) == F.col("g_sha")))
    groups = bodies.groupBy("g_fp", "g_sha", "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size")).drop("text")
    joined = prints.join(groups, (F.col("fp") == F.col("g_fp")) & (F.col("text_sha256") == F.col("g_sha")), "left")
    keep = F.coalesce("top", "doc_id")
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), "text_sha256")
