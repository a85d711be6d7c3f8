r"""Reversible line deduplication (operator 3).

A line's key is the line without white space [\x20\x09-\x0D] at both ends and
with A-Z lower-cased, as 128 bits of hash.  The index holds three tables:

* ``postings``: (hi, lo, doc_id), one row per key and document;
* ``counts``: (hi, lo, n_docs, first_doc), the exact reference counts;
* ``filters``: (shard, filter), a cuckoo filter per shard of keys, holding the
  keys that two documents or more share.

``insert`` and ``delete`` change postings and counts of the touched keys only,
and put a key into its shard's filter or take it out as its count crosses two:
a deletion undoes an insertion.  ``drops`` probes lines against the filters
first, so lines that nobody shares go no further, then asks the exact table;
a false positive of a filter drops nothing.

The filters are broadcast to the probing tasks while they are small
(``FILTER_BYTES``, measured before); beyond, lines go to the exact table
unprobed, with the same rows.  A line in a third of all documents is counted
per task before the shuffle, and its join with the counts is an ordinary
equi-join which Spark splits when skewed.

Null or empty text: one empty line, never dropped.  Rows with the same doc_id
are one document.  Empty tables give empty results.  Other columns of the
documents are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import small_batches, stored, texts

MIN_CHARS = 10
SHARDS = 64
FILTER_BYTES = 32 << 20
_STRIP = " \t\n\x0b\x0c\r"
_KEY = ["hi", "lo"]


def line_key(line: str, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """(hi, lo) of the line's key; None if the key is too short to count."""
    key = line.strip(_STRIP)
    if len(key) < min_chars:
        return None
    h = xxhash.xxh3_128_digest(key.encode().lower())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, each in one of two buckets.

    Supports removal.  What finds no place within the allowed moves goes to a
    stash, so nothing is lost.  Keys are given as (hi, lo) int64 arrays."""

    SLOTS, MOVES = 4, 200

    def __init__(self, capacity: int):
        self.mask = (1 << max(3, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.9))))) - 1
        self.table = np.zeros((self.mask + 1, self.SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (lo.astype(np.int64).view(np.uint64) >> np.uint64(48)).astype(np.int64)
        print_[print_ == 0] = 1
        first = (hi.astype(np.int64).view(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return print_, first, first ^ self._step(print_)

    def _step(self, print_):
        return (print_ * 0x5BD1E995) & self.mask

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        rng = np.random.default_rng(len(hi))
        for fp, a, b in zip(*(x.tolist() for x in self._places(hi, lo)), strict=True):
            at = a
            for move in range(self.MOVES):
                for place in (a, b) if not move else (at,):
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = fp
                        break
                else:
                    at = at if move else (a, b)[int(rng.integers(2))]
                    slot = int(rng.integers(self.SLOTS))
                    fp, self.table[at, slot] = int(self.table[at, slot]), fp
                    at ^= int(self._step(fp))
                    continue
                break
            else:
                self.stash.append((fp, min(at, at ^ int(self._step(fp)))))

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for fp, a, b in zip(*(x.tolist() for x in self._places(hi, lo)), strict=True):
            for place in (a, b):
                held = np.flatnonzero(self.table[place] == fp)
                if len(held):
                    self.table[place, held[0]] = 0
                    break
            else:
                if (fp, min(a, b)) in self.stash:
                    self.stash.remove((fp, min(a, b)))

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(hi, lo)
        found = (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)
        if self.stash:
            held = set(self.stash)
            found |= np.fromiter(((f, min(x, y)) in held for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist(), strict=True)), bool, len(fp))
        return found

    def to_bytes(self) -> bytes:
        return np.array([self.mask, len(self.stash)], "<i8").tobytes() + np.array(self.stash, "<i8").reshape(-1, 2).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.mask, n = (int(x) for x in np.frombuffer(data[:16], "<i8"))
        out.stash = [(int(f), int(b)) for f, b in np.frombuffer(data[16 : 16 + 16 * n], "<i8").reshape(-1, 2)]
        out.table = np.frombuffer(data[16 + 16 * n :], np.uint16).reshape(-1, cls.SLOTS).copy()
        return out


class LineIndex(NamedTuple):
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _keys(min_chars: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, his, los = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                for hi, lo in {k for line in text.as_py().split("\n") if (k := line_key(line, min_chars))}:
                    ids.append(doc_id)
                    his.append(hi)
                    los.append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(ids, pa.int64())], names=["hi", "lo", "doc_id"])

    return run


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc_id): each document's distinct keys that are long enough."""
    return texts(docs).mapInArrow(_keys(min_chars), "hi long, lo long, doc_id long")


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t.column("hi").to_numpy(), t.column("lo").to_numpy()


def _filter_row(shard: int, f: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})


def _build_filter(keys: pa.Table) -> pa.Table:
    f = CuckooFilter(2 * keys.num_rows)
    f.insert(*_arrays(keys))
    return _filter_row(keys.column("shard")[0].as_py(), f)


def _change_filter(held: pa.Table, changes: pa.Table) -> pa.Table:
    shard = (held if held.num_rows else changes).column("shard")[0].as_py()
    f = CuckooFilter.from_bytes(held.column("filter")[0].as_py()) if held.num_rows else CuckooFilter(2 * changes.num_rows)
    f.remove(*_arrays(changes.filter(pa.compute.equal(changes.column("change"), -1))))
    f.insert(*_arrays(changes.filter(pa.compute.equal(changes.column("change"), 1))))
    return _filter_row(shard, f)


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> LineIndex:
    """The index of all lines of docs, its tables stored in the shared folder."""
    postings = stored(line_postings(docs, min_chars).distinct() if _may_repeat(docs) else line_postings(docs, min_chars), "line-postings")
    return _with_filters(postings, shards)


def _may_repeat(docs: DataFrame) -> bool:
    """Whether any doc_id occurs twice (its keys then need a distinct)."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())


def _with_filters(postings: DataFrame, shards: int) -> LineIndex:
    counts = stored(_counted(postings), "line-counts")
    shared = counts.filter("n_docs >= 2").select(*_KEY, _shard(shards).alias("shard"))
    filters = stored(shared.groupBy("shard").applyInArrow(_build_filter, "shard int, filter binary"), "line-filters")
    return LineIndex(postings, counts, filters, shards)


def _updated(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index with new postings, where only the touched keys have changed."""
    postings = stored(postings.select(*_KEY, "doc_id"), "line-postings")
    keys = stored(touched.select(*_KEY).distinct(), "line-touched")
    after = _counted(postings.join(keys, _KEY, "left_semi"))
    counts = stored(index.counts.join(keys, _KEY, "left_anti").unionByName(after), "line-counts")

    def is_shared(t: DataFrame, name: str) -> DataFrame:
        return t.join(keys, _KEY, "left_semi").select(*_KEY, (F.col("n_docs") >= 2).alias(name))

    crossed = is_shared(index.counts, "old").join(is_shared(counts, "new"), _KEY, "full").select(*_KEY, _shard(index.shards).alias("shard"), (F.coalesce("new", F.lit(False)).cast("int") - F.coalesce("old", F.lit(False)).cast("int")).alias("change")).filter("change <> 0")
    filters = index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(_change_filter, "shard int, filter binary")
    return LineIndex(postings, counts, stored(filters, "line-filters"), index.shards)


def insert(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with docs added; a document that is in it already changes nothing."""
    new = line_postings(docs, min_chars).distinct().join(index.postings, [*_KEY, "doc_id"], "left_anti")
    new = stored(new, "line-new")
    return _updated(index, index.postings.unionByName(new), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents whose doc_id is in doc_ids."""
    gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return _updated(index, index.postings.join(gone, "doc_id", "left_anti"), index.postings.join(gone, "doc_id", "left_semi"))


def _prober(filters: dict[int, bytes], shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter.from_bytes(f) for s, f in filters.items()}
        for b in batches:
            hi, lo = b.column("hi").to_numpy(), b.column("lo").to_numpy()
            shard = hi % shards
            found = np.zeros(len(hi), bool)
            for s, f in held.items():
                at = np.flatnonzero(shard == s)
                found[at] = f.contains(hi[at], lo[at])
            yield b.filter(pa.array(found))

    return run


def drops(index: LineIndex) -> DataFrame:
    """(doc_id, hi, lo): keys that lose their lines in that document, being
    shared and held by a document with a smaller id."""
    postings = index.postings
    if (index.filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= FILTER_BYTES:
        filters = {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()}
        postings = postings.mapInArrow(_prober(filters, index.shards), "hi long, lo long, doc_id long")
    shared = index.counts.filter("n_docs >= 2").select(*_KEY, "first_doc")
    return postings.join(shared, _KEY).filter("doc_id <> first_doc").select("doc_id", *_KEY)


def _kept_lines(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept_texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(b.column("_text"), b.column("_drops"), strict=True):
                lines = text.as_py().split("\n")
                gone = {(g["hi"], g["lo"]) for g in gone.as_py() or ()}
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                kept_texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), pa.array(kept_texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*b.schema.names[:-2], "kept_text", "n_lines", "n_dropped"])

    return run


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, index: LineIndex | None = None) -> DataFrame:
    """Every row of docs as (doc struct, kept_text, n_lines, n_dropped)."""
    small_batches(docs.sparkSession)
    index = index or build_index(docs, min_chars)
    lost = drops(index).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct(*_KEY)).alias("_drops"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("_id", F.col("doc.doc_id").cast("long")).join(lost, "_id", "left")
    rows = rows.select("doc", F.coalesce("doc.text", F.lit("")).alias("_text"), "_drops")
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_kept_lines(min_chars), f"doc {kind}, kept_text string, n_lines long, n_dropped long")


def kept_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
