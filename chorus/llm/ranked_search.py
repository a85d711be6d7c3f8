r"""Ranked lexical search by sequential reads of impact-sorted lists (operator 11).

The index is distributed by document.  A shard is a block of documents with, for
each of its terms, a list of (document, impact) in descending order of impact;
the impact is a term's share of a document's score but for the term's weight.
Building it needs two totals of the corpus (documents with terms, and terms), and
no shuffle; a very frequent term is split over all shards.

A search works on all queries, in blocks of ``BLOCK`` distinct query terms or one
query at least, which Spark writes to the shared folder and the tasks map; neither
queries nor postings pass through the driver.

1. Each shard gives the document frequencies of the query terms it holds; their
   sums give the weights.
2. NRA (no random access): each task reads the lists of a query's terms from the
   top, in steps.  A document's score lies between what has been read of it, and
   that plus, for each list it has not been seen in, what stands next in it.  A
   document whose upper end is below the k-th best lower end is out, and when no
   unseen document can reach that bound either, only the documents left are
   followed, until all their intervals are points: membership, ties and final
   scores are then resolved.  The bound goes with the task from shard to shard.
3. Tasks' results meet in two steps, first in groups of tasks, then per query.

Scores are 64-bit integers, so the order is exact.  Terms are runs of
[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] after A-Z are lower-cased, compared by 64-bit
hashes.  Null texts have no terms: such documents are never found, such queries find
nothing.  Queries that share an id are one query with the terms of all, null ids too.
Rows of documents that share a doc_id are documents of their own; a null id comes
last among ties.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import _planes, _values, get_array, new_folder, put_array, rows_of, slice_rows, stored, texts

SHARD_BYTES = 16 << 20
#: Distinct terms of the queries that a task holds at a time.
BLOCK = 200_000
#: Postings of each list that are read at first; every further step doubles what has been read.
FIRST = 64
#: Pairs of a term and a document whose state a task holds at a time.
STATE = 32 << 20
#: Groups of tasks whose results meet first.
GROUPS = 64
NO_ID = np.iinfo(np.int64).max

_INDEX = "docs array<long>, n_terms long, terms binary, lengths binary, places binary, steps binary"


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, length = 0, 0
    for b in (part for whole in batches for part in slice_rows(whole)):
        data, offsets = tokens.string_bytes(b.column("text"))
        if not len(data):
            continue
        inside = ~tokens.NOT_ALNUM[tokens.LOWER[data]]
        begins = inside & ~np.r_[False, inside[:-1]]
        first = offsets[:-1][offsets[:-1] < len(data)]
        begins[first] = inside[first]
        per_text = np.diff(np.r_[0, np.cumsum(begins)][offsets])
        n, length = n + int((per_text > 0).sum()), length + int(per_text.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], names=["n", "length"])


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """A term's part of a document's score before its weight; the document has ``length`` terms."""
    norm = 10 + 90 * length * n // max(total, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def _shards(n: int, total: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shard(ids: list, sizes: list, parts: list) -> pa.RecordBatch:
        doc_size = np.concatenate(sizes)
        base = np.cumsum([0, *(len(s) for s in sizes)])
        term = np.concatenate([t for t, _, _ in parts])
        doc = np.concatenate([d + b for (_, d, _), b in zip(parts, base, strict=False)])
        impact = impacts(np.concatenate([c for _, _, c in parts]), doc_size[doc], n, total)
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        # impacts fall along a list: stored as steps down, the first as it is
        step = -np.diff(impact, prepend=0)
        step[first] = impact[first]
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([len(first)], pa.int64()), *(pa.array([_planes(x.astype(np.uint64))], pa.binary()) for x in (np.diff(term[first], prepend=np.uint64(0)), np.diff(np.r_[first, len(term)]), doc, step))], names=["docs", "n_terms", "terms", "lengths", "places", "steps"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, held = [], [], [], 0
        for b in (part for whole in batches for part in slice_rows(whole)):
            data, offsets = tokens.string_bytes(b.column("text"))
            h, _, _, first = tokens.words(data, offsets, tokens.NOT_ALNUM)
            doc = tokens.lengths_to_index(np.diff(first))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, np.int64)
            parts.append((h[new], doc[new], np.diff(np.r_[new, len(h)])))
            ids.append(b.column("doc_id").fill_null(NO_ID).to_numpy())
            sizes.append(np.diff(first))
            held += len(data)
            if held >= SHARD_BYTES:
                yield shard(ids, sizes, parts)
                ids, sizes, parts, held = [], [], [], 0
        if ids:
            yield shard(ids, sizes, parts)

    return run


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The stored index of all of docs, a row per shard, and the number of documents with terms."""
    rows = texts(docs)
    totals = rows.select("text").mapInArrow(_totals, "n long, length long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return stored(rows.mapInArrow(_shards(*totals), _INDEX), "impact-index"), totals[0]


class Shard:
    """A row of the index, unpacked."""

    def __init__(self, docs, n_terms: int, terms: bytes, lengths: bytes, places: bytes, steps: bytes):
        self.docs = np.asarray(docs, np.int64)
        self.terms = np.cumsum(_values(terms, n_terms), dtype=np.uint64)
        self.first = np.r_[0, np.cumsum(_values(lengths, n_terms).astype(np.int64))]
        self.places = _values(places, int(self.first[-1])).astype(np.int64)
        step = _values(steps, int(self.first[-1])).astype(np.int64)
        step[self.first[:-1]] *= -1
        run = np.cumsum(-step)
        begun = np.r_[0, run][self.first[:-1]]
        self.impacts = run - np.repeat(begun, np.diff(self.first))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Each term's number in the shard, -1 if it has none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def list(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents' places, impacts) of a term, highest impact first."""
        cut = slice(self.first[number], self.first[number + 1])
        return self.places[cut], self.impacts[cut]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, bound: int = 1, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that may be among the k best: all with at least the score of
    the k-th best of these lists, or ``bound`` if that is higher.

    lists: (documents, parts of their scores) of each term in descending order of the
    parts.  Every list is read from its top on, each posting once."""
    lower = np.zeros(n_docs, np.int64)
    unseen = np.ones((len(lists), n_docs), bool)
    read = np.zeros(len(lists), np.int64)
    sizes = np.array([len(d) for d, _ in lists], np.int64)
    alive: np.ndarray | None = None  # None: any document may still come up
    depth = first
    while True:
        for i, (docs, parts) in enumerate(lists):
            if read[i] < sizes[i]:
                end = min(depth, sizes[i])
                lower[docs[read[i] : end]] += parts[read[i] : end]
                unseen[i, docs[read[i] : end]] = False
                read[i] = end
        following = np.array([p[r] if r < len(p) else 0 for (_, p), r in zip(lists, read, strict=True)], np.int64)
        if alive is None:
            touched = np.flatnonzero(lower >= 1)
            bar = max(bound, int(np.partition(lower[touched], -k)[-k]) if len(touched) >= k else 0)
            if following.sum() < bar:
                alive = touched  # a document that no list has shown can no longer come in
        if alive is not None:
            upper = lower[alive] + following @ unseen[:, alive]
            bar = max(bound, int(np.partition(lower[alive], -k)[-k]) if len(alive) >= k else 0)
            alive, upper = alive[upper >= bar], upper[upper >= bar]
            if (upper == lower[alive]).all():
                return alive, lower[alive]
        depth *= 2


def _part(lists: list[tuple[np.ndarray, np.ndarray]], low: int, high: int, n_docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lists of documents low to high, numbered from low."""
    if low == 0 and high >= n_docs:
        return lists
    inside = [(docs >= low) & (docs < high) for docs, _ in lists]
    return [(docs[m] - low, parts[m]) for (docs, parts), m in zip(lists, inside, strict=True)]


def _query_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slice_rows(whole)):
        data, offsets = tokens.string_bytes(b.column("text"))
        h, _, _, first = tokens.words(data, offsets, tokens.NOT_ALNUM)
        sets = [np.unique(h[a:z]).view(np.int64) for a, z in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("query"), pa.array(sets, pa.list_(pa.int64()))], names=["query", "terms"])


def _write_terms(folder: str) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        terms = np.unique(t.column("term").to_numpy().view(np.uint64))
        return pa.table({"block": t.column("block")[:1], "file": [put_array(folder, "terms", terms)]})

    return run


def _frequencies(folder: str, files: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            shard = Shard(**row)
            size = np.diff(shard.first)
            for name in files:
                terms = get_array(folder, name, np.uint64)
                at = shard.find(terms)
                held = at >= 0
                yield pa.RecordBatch.from_arrays([pa.array(terms[held].view(np.int64)), pa.array(size[at[held]], pa.int64())], names=["term", "df"])

    return run


def _write_queries(folder: str) -> Callable[[pa.Table], pa.Table]:
    """A block's queries as arrays: terms and weights, and where each query's begin."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("query", "ascending"), ("term", "ascending")])
        query = t.column("query").to_numpy()
        begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        files = [put_array(folder, name, x) for name, x in (("query", query[begin]), ("begin", np.r_[begin, len(query)]), ("term", t.column("term").to_numpy()), ("weight", t.column("weight").to_numpy()))]
        return pa.table({"block": t.column("block")[:1], "files": pa.array([files], pa.list_(pa.string()))})

    return run


def _search(folder: str, blocks: list[list[str]], k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def best(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        so_far: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in rows_of(batches):
            shard = Shard(**row)
            for files in blocks:
                query, begin, term, weight = (get_array(folder, name, np.int64) for name in files)
                at = shard.find(term.view(np.uint64))
                for q, a, z in zip(query.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    held = [(docs, w * impact) for i, w in zip(at[a:z].tolist(), weight[a:z].tolist(), strict=True) if i >= 0 and w > 0 for docs, impact in [shard.list(i)]]
                    if not held:
                        continue
                    known = so_far.get(q)
                    bound = int(known[1][-1]) if known and len(known[1]) == k else 1
                    if sum(int(parts[0]) for _, parts in held) < bound:
                        continue
                    step = max(1, STATE // len(held))
                    for low in range(0, len(shard.docs), step):
                        docs, scores = nra(_part(held, low, low + step, len(shard.docs)), min(step, len(shard.docs) - low), k, bound)
                        if len(docs):
                            known = so_far[q] = best([*([known] if known else []), (shard.docs[docs + low], scores)])
                            bound = int(known[1][-1]) if len(known[1]) == k else bound
        for q, (ids, scores) in so_far.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int64()), pa.array([task % GROUPS] * len(ids), pa.int32()), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["query", "part", "doc_id", "score"])

    return run


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each (item_id, text): (item_id, rank, doc_id, score).

    Documents score above 0; equal scores go by ascending doc_id."""
    spark = index.sparkSession
    folder = new_folder(spark, "queries")
    items = stored(queries.select("item_id").distinct().withColumn("query", F.monotonically_increasing_id()), "query-items")
    rows = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")).join(items, queries["item_id"].eqNullSafe(items["item_id"]))
    sets = rows.select("query", "text").mapInArrow(_query_terms, "query long, terms array<long>")
    terms = stored(sets.select("query", F.explode("terms").alias("term")).distinct(), "query-terms")
    n_blocks = max(1, math.ceil(terms.count() / BLOCK))
    distinct = terms.select("term", F.pmod(F.col("term"), F.lit(n_blocks)).alias("block")).distinct()
    files = [r["file"] for r in distinct.groupBy("block").applyInArrow(_write_terms(folder), "block long, file string").collect()]
    df = index.mapInArrow(_frequencies(folder, files), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = terms.join(df, "term").select("query", "term", weight.alias("weight"))
    # whole queries to blocks; a block's share of the terms is BLOCK, and one query's terms at most more
    place = F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block")
    blocks = [r["files"] for r in weighted.select("query", "term", "weight", place).groupBy("block").applyInArrow(_write_queries(folder), "block long, files array<string>").collect()]
    found = index.mapInArrow(_search(folder, blocks, k), "query long, part int, doc_id long, score long")
    for keys in (["query", "part"], ["query"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.join(items, "query").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best of all documents for each query: (item_id, rank, doc_id, score)."""
    index, n = build_index(docs)
    return search(index, n, queries, k)


def scores_by_reading_all(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int) -> np.ndarray:
    """What nra() resolves, from every posting: for tests and comparison."""
    return reduce(lambda total, x: total + np.bincount(x[0], x[1], n_docs).astype(np.int64), lists, np.zeros(n_docs, np.int64))
