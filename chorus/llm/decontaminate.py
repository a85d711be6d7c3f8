r"""Benchmark passages in training texts by a positional inverted index (operator 8).

``build_index`` stores, for every training word, where it stands.  The index is
distributed by document: a shard holds a block of documents, its sorted term
hashes, and for each term the ascending list of its positions in the block
(texts lie one after another, with gaps that no phrase can bridge).  Building
needs no shuffle, and a very frequent word is split over all shards.

Test windows are looked up in blocks of ``WINDOW_BLOCK`` windows, so what is
broadcast at a time has a fixed bound whatever the benchmark's size.  In each
shard a window begins with its rarest term's list, shifted by the term's offset
in the window, and intersects it with the other lists from rare to frequent,
until no position is left or all words agree.  ``proximity_matches`` asks for
all words of a window within a span instead of in order.

Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.  Null
texts have no words: such documents are clean, such items never occur.  An item
of fewer words than a window is one window.  Items with equal ids count once.
Repeated documents get a row each; empty tables give clean or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import _planes, _values, stored, texts

WINDOW = 10
WINDOW_BLOCK = 500_000
SHARD_BYTES = 16 << 20
GAP = 1 << 10

_INDEX = "docs array<long>, sizes array<long>, n_terms long, terms binary, lengths binary, positions binary"


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    held = 0

    def shard() -> pa.RecordBatch:
        size, h = np.concatenate(sizes), np.concatenate(hashes)
        at = np.arange(len(h)) + GAP * tokens.lengths_to_index(size)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        apart = np.diff(at, prepend=0)
        apart[first] = at[first]
        terms = h[first]
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([size], pa.list_(pa.int64())), pa.array([len(terms)], pa.int64()), pa.array([_planes(np.diff(terms, prepend=np.uint64(0)))], pa.binary()), pa.array([_planes(np.diff(np.r_[first, len(h)]).astype(np.uint64))], pa.binary()), pa.array([_planes(apart.astype(np.uint64))], pa.binary())], names=["docs", "sizes", "n_terms", "terms", "lengths", "positions"])

    for b in batches:
        for start, end in tokens.slices(b.column("text"), SHARD_BYTES):
            part = b.slice(start, end - start)
            data, offsets = tokens.string_bytes(part.column("text"))
            h, _, _, first = tokens.words(data, offsets, tokens.NOT_ALNUM)
            ids.append(part.column("doc_id").to_numpy())
            sizes.append(np.diff(first))
            hashes.append(h)
            held += len(data)
            if held >= SHARD_BYTES:
                yield shard()
                ids, sizes, hashes, held = [], [], [], 0
    if ids:
        yield shard()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all of docs' words: a row per shard."""
    return stored(texts(docs).mapInArrow(_shards, _INDEX), "positional-index")


class Shard:
    """A row of the index, unpacked."""

    def __init__(self, docs, sizes, n_terms: int, terms: bytes, lengths: bytes, positions: bytes):
        self.docs, self.sizes = np.asarray(docs, np.int64), np.asarray(sizes, np.int64)
        self.begin = np.r_[0, np.cumsum(self.sizes)][:-1] + GAP * np.arange(len(self.sizes))
        self.terms = np.cumsum(_values(terms, n_terms), dtype=np.uint64)
        self.first = np.r_[0, np.cumsum(_values(lengths, n_terms).astype(np.int64))]
        apart = _values(positions, int(self.first[-1])).astype(np.int64)
        total = np.r_[0, np.cumsum(apart)]
        of = tokens.lengths_to_index(np.diff(self.first))
        self.at = total[1:] - total[self.first[:-1]][of]

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Each term's number in the shard, -1 if it has none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.at[self.first[term] : self.first[term + 1]]

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand one after another."""
        start: np.ndarray | None = None
        for offset in np.argsort(self.first[numbers + 1] - self.first[numbers], kind="stable"):
            shifted = self.postings(numbers[offset])
            if start is None:
                start = shifted - offset
            else:
                i = np.searchsorted(shifted, start + offset)
                start = start[(i < len(shifted)) & (shifted[np.minimum(i, len(shifted) - 1)] == start + offset)]
            if not len(start):
                break
        return start

    def near(self, numbers: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term from which every other term lies less than span away."""
        order = np.argsort(self.first[numbers + 1] - self.first[numbers], kind="stable")
        start = self.postings(numbers[order[0]])
        for k in order[1:]:
            other = self.postings(numbers[k])
            i = np.searchsorted(other, start)
            right = np.where(i < len(other), other[np.minimum(i, len(other) - 1)] - start, span)
            left = np.where(i > 0, start - other[np.maximum(i, 1) - 1], span)
            start = start[np.minimum(left, right) < span]
        return start

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1


def _windows_of(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tokens.string_bytes(b.column("text"))
            h, _, _, first = tokens.words(data, offsets, tokens.NOT_ALNUM)
            items, windows = [], []
            for item, a, z in zip(b.column("item").to_pylist(), first[:-1], first[1:], strict=True):
                starts = range(a, max(z - size, a) + 1) if z > a else ()
                windows += [h[s : min(s + size, z)].view(np.int64) for s in starts]
                items += [item] * len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.list_(pa.int64()))], names=["item", "terms"])

    return run


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(terms, items): the distinct windows of (item_id, text) rows with the items that hold them."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_windows_of(size), "item string, terms array<long>").groupBy("terms").agg(F.collect_set("item").alias("items"))


def _blocks(found: DataFrame) -> Iterator[list]:
    """Test windows in blocks of bounded size."""
    block: list = []
    for r in found.toLocalIterator():
        block.append((np.array(r["terms"], np.int64).view(np.uint64), sorted(r["items"])))
        if len(block) == WINDOW_BLOCK:
            yield block
            block = []
    yield block


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1]
    return begin[new], end[last]


_HITS = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _matcher(block, whole: bool, span: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents with hits; with whole, also of those without."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = block.value
        sizes = np.array([len(t) for t, _ in test], np.int64)
        flat = np.concatenate([t for t, _ in test]) if test else np.empty(0, np.uint64)
        cut = np.r_[0, np.cumsum(sizes)]
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(**row)
                numbers = shard.find(flat)
                present = np.flatnonzero(np.minimum.reduceat(numbers, cut[:-1]) >= 0) if test else []
                hit_doc, hit_from, hit_to, hit_window = [], [], [], []
                for w in present:
                    mine = numbers[cut[w] : cut[w + 1]]
                    at = shard.phrase(mine) if span is None else shard.near(mine, span)
                    if len(at):
                        doc = shard.doc_of(at)
                        hit_doc.append(doc)
                        hit_from.append(at - shard.begin[doc])
                        hit_to.append(at - shard.begin[doc] + (len(mine) if span is None else 1))
                        hit_window.append(np.full(len(at), w))
                starts: list = [[] for _ in shard.docs]
                ends: list = [[] for _ in shard.docs]
                items: list = [[] for _ in shard.docs]
                if hit_doc:
                    doc, a, z, w = (np.concatenate(x) for x in (hit_doc, hit_from, hit_to, hit_window))
                    order = np.argsort(doc, kind="stable")
                    doc, a, z, w = doc[order], a[order], z[order], w[order]
                    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    for s, e in zip(edge, np.r_[edge[1:], len(doc)], strict=True):
                        starts[doc[s]], ends[doc[s]] = _merged(a[s:e], z[s:e])
                        items[doc[s]] = sorted({i for x in np.unique(w[s:e]) for i in test[x][1]})
                keep = [i for i in range(len(shard.docs)) if whole or len(starts[i])]
                yield pa.RecordBatch.from_arrays([pa.array(shard.docs[keep], pa.int64()), pa.array(shard.sizes[keep], pa.int64()), *(pa.array([list(x[i]) for i in keep], pa.list_(pa.int64())) for x in (starts, ends)), pa.array([items[i] for i in keep], pa.list_(pa.string()))], names=["doc_id", "n_words", "starts", "ends", "items"])

    return run


def _matches(index: DataFrame, items: DataFrame, size: int, span: int | None) -> DataFrame:
    """Every document of the index as (doc_id, n_words, starts, ends, items)."""
    spark, out = index.sparkSession, None
    for k, block in enumerate(_blocks(windows(items, size))):
        found = index.mapInArrow(_matcher(spark.sparkContext.broadcast(block), k == 0, span), _HITS)
        if out is None:
            out = found
        else:  # later blocks add to the documents' rows of the first
            more = found.groupBy("doc_id").agg(F.first("starts").alias("s"), F.first("ends").alias("e"), F.first("items").alias("i"))
            joined = out.join(stored(more, "index-matches"), "doc_id", "left")
            out = joined.select("doc_id", "n_words", *(F.concat(a, F.coalesce(b, F.array().cast("array<long>"))).alias(a) for a, b in (("starts", "s"), ("ends", "e"))), F.array_union("items", F.coalesce("i", F.array().cast("array<string>"))).alias("items"))
    return out


def phrase_matches(index: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Exact occurrences of the items' windows: every document as (doc_id, n_words,
    starts, ends, items), word intervals from each block of windows merged."""
    return _matches(index, items, size, None)


def proximity_matches(index: DataFrame, items: DataFrame, size: int = WINDOW, span: int = 2 * WINDOW) -> DataFrame:
    """Documents where all words of a window lie less than span from its rarest
    word; the intervals are the positions of that word."""
    return _matches(index, items, size, span).filter(F.size("starts") > 0)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit, sha = [], []
        for starts, ends, items in zip(b.column("starts"), b.column("ends"), b.column("items"), strict=True):
            if len(starts):
                a, z = _merged(np.array(starts.as_py()), np.array(ends.as_py()))
                hit.append(int((z - a).sum()))
            else:
                hit.append(0)
            sha.append(hashlib.sha256(",".join(sorted(items.as_py())).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in b.column("items").to_pylist()], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every row of docs as (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    # stored between: a task that matches and digests at once holds two Python workers, and executors keep them
    found = stored(phrase_matches(build_index(docs), benchmark, size), "index-hits")
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
