r"""Collocations by dynamic itemset counting of phrases (operator 13).

The corpus is stored once as blocks of numbered words, dealt to ``SHARDS`` shards.
Scans go round the shards, one at a time, and count phrases of all lengths at once:

* words are counted from the first scan on;
* a phrase of two words is counted from the scan after the one in which the counts
  so far of both its words have reached the threshold, a phrase of three from the
  one after both its two-word parts have;
* each phrase is counted for one full cycle of the shards from there on, so its
  count is that of the whole corpus, and the scans end when all cycles are closed.

No phrase that reaches the threshold has a part that doesn't, so none is missed.

After a scan, tasks' counts meet by range of the phrases' hashes, are added to the
counts so far, and the phrases that are active from then on go to sorted arrays in
the shared folder, which the tasks of the next scan map range by range.  Each count
goes with the place of one occurrence, from which the words of the phrases that
remain are read at the end.  Only the names of files pass through the driver.

A piece is a run without [.,;:!?\x0A-\x0D], its words are [^\x20\x09]+ with A-Z
lower-cased; phrases lie within pieces.  All is per lang, null standing for ``und``.
Null and empty texts have no words.  Repeated rows count as often as they occur,
whatever their ids; ids and other columns are not read.  An empty table gives no rows.
Words and phrases are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import _planes, _values, get_array, new_folder, pack, put_array, rows_of, small_batches, stored, unpack

SHARDS = 4
LONGEST = 3
#: Words of a block; the bits of a place in it.
BLOCK, BITS = 1 << 20, 20
#: Words of the corpus for each range of hashes, and the most ranges.
PER_RANGE, MOST_RANGES = 2_000_000, 4096
#: Counted phrases that a task holds before it hands them on.
FLUSH = 1_000_000
INACTIVE = 255
#: Parts of a group whose rows are ranked first.
SALTS = 32

_bytes = np.arange(256)
_HARD = np.isin(_bytes, [*b".,;:!?", 10, 11, 12, 13])
_SEPARATORS = _HARD | np.isin(_bytes, [32, 9])
_STEP = np.uint64(0x9FB21C651E98DF25)

_BLOCKS = "block long, shard int, own int, size int, n_words int, hashes binary, places binary, breaks binary, words binary, word_langs binary, langs array<string>, lang_counts array<long>"


def _lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _blocks(shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for start, end in tokens.slices(b.column("text")):
                part = b.slice(start, end - start)
                data, offsets = tokens.string_bytes(part.column("text"))
                h, begin, close, first = tokens.words(data, offsets, _SEPARATORS)
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                lang = np.array([names.index(x) for x in langs], np.int64)[tokens.lengths_to_index(np.diff(first))]
                h = tokens.mix(h ^ np.array([_lang_hash(x) for x in names], np.uint64)[lang])
                hard = np.r_[0, np.cumsum(_HARD[data])]
                breaks = np.ones(len(h), bool)
                breaks[1:] = hard[begin[1:]] > hard[close[:-1]]
                breaks[first[:-1][first[:-1] < len(h)]] = True
                for at in range(0, len(h), BLOCK):
                    # two words of the next block follow, for the phrases that begin in this one
                    own, here = min(BLOCK, len(h) - at), slice(at, at + BLOCK + LONGEST - 1)
                    keys, one, places = np.unique(h[here], return_index=True, return_inverse=True)
                    one = one + at
                    size = close[one] - begin[one]
                    text = tokens.LOWER[data[tokens.ragged(begin[one], size)]]
                    used, n = np.unique(lang[at : at + own], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number], pa.int64()),
                            pa.array([number % shards], pa.int32()),
                            pa.array([own], pa.int32()),
                            pa.array([len(places)], pa.int32()),
                            pa.array([len(keys)], pa.int32()),
                            *(pa.array([x], pa.binary()) for x in (_planes(np.diff(keys, prepend=np.uint64(0))), _planes(places.astype(np.uint64)), press.compress(np.packbits(breaks[here]).tobytes()), press.compress(size.astype("<u4").tobytes() + text.tobytes()), _planes(lang[one].astype(np.uint64)))),
                            pa.array([names], pa.list_(pa.string())),
                            pa.array([[int(n[used == i].sum()) for i in range(len(names))]], pa.list_(pa.int64())),
                        ],
                        names=["block", "shard", "own", "size", "n_words", "hashes", "places", "breaks", "words", "word_langs", "langs", "lang_counts"],
                    )
                    number += 1

    return run


class Block:
    """A stored block: its words' hashes in order, and which of them begin a piece."""

    def __init__(self, row: dict):
        self.number, self.own, n = row["block"], row["own"], row["n_words"]
        self.keys = np.cumsum(_values(row["hashes"], n), dtype=np.uint64)
        breaks = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["breaks"]), np.uint8)).astype(bool)
        self.places = _values(row["places"], row["size"]).astype(np.int64)
        self.breaks = breaks[: row["size"]]
        self.hashes = self.keys[self.places]

    def pairs(self) -> np.ndarray:
        return tokens.mix(self.hashes[:-1] * _STEP + self.hashes[1:])

    def joined(self) -> np.ndarray:
        """Whether a word and the next lie in one piece."""
        return ~self.breaks[1:]


class Active:
    """Phrases of a length that have reached the threshold: sorted arrays by range of hash."""

    def __init__(self, folder: str, files: dict[int, list[str]], ranges: int):
        self.folder, self.files, self.ranges = folder, files, ranges

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scan from which they are counted in longer phrases, count) of sorted keys."""
        since, count = np.full(len(keys), INACTIVE, np.uint8), np.zeros(len(keys), np.int64)
        cut = _cut(keys, self.ranges)
        for r in np.flatnonzero(np.diff(cut)):
            if r in self.files:
                held, begun, counts = (get_array(self.folder, name, kind) for name, kind in zip(self.files[r], (np.uint64, np.uint8, np.int64), strict=True))
                if len(held):
                    here = slice(cut[r], cut[r + 1])
                    i = np.minimum(np.searchsorted(held, keys[here]), len(held) - 1)
                    hit = held[i] == keys[here]
                    since[here] = np.where(hit, begun[i], INACTIVE)
                    count[here] = np.where(hit, counts[i], 0)
        return since, count


def _cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of sorted keys begin and end."""
    if ranges == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - (ranges.bit_length() - 1))
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal keys as one: keys sorted, counts added up, of all further columns the least."""
    key, count, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    if not len(first):
        return [key, count, *others]
    return [key[first], np.add.reduceat(count[order], first), *(np.minimum.reduceat(x[order], first) for x in others)]


class State(dict):
    """(length, range) to the names of files: all counts so far, and the arrays of the active phrases."""

    def active(self, folder: str, length: int, ranges: int) -> Active:
        return Active(folder, {r: files[1:4] for (n, r), files in self.items() if n == length}, ranges)


def _scan(folder: str, state: State, ranges: int, step: int, shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a scan's blocks: (length, range, entries)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (state.active(folder, n, ranges) for n in (1, 2))
        found: dict[int, list[list[np.ndarray]]] = {n: [] for n in range(1, LONGEST + 1)}

        def keep(length: int, key: np.ndarray, count: np.ndarray, place: np.ndarray) -> None:
            found[length].append([key, count, (place + (block.number << BITS)).astype(np.int64)])

        def counted(since: np.ndarray) -> np.ndarray:
            return (since <= step) & (step < since.astype(np.int64) + shards)

        def flush() -> Iterator[pa.RecordBatch]:
            for length, parts in found.items():
                if parts:
                    key, count, place = _merged(parts)
                    cut = _cut(key, ranges)
                    used = np.flatnonzero(np.diff(cut))
                    yield pa.RecordBatch.from_arrays([pa.array([length] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([pack(*(x[cut[r] : cut[r + 1]] for x in (key, count, place))) for r in used], pa.binary())], names=["length", "range", "entries"])
                parts.clear()

        for row in rows_of(batches):
            block = Block(row)
            own, n = block.own, len(block.hashes)
            if step < shards:
                use, first, count = np.unique(block.places[:own], return_index=True, return_counts=True)
                keep(1, block.keys[use], count, first)
            since = words.look_up(block.keys)[0][block.places]
            key = block.pairs()
            both = np.maximum(since[:-1], since[1:])
            at = np.flatnonzero(block.joined() & (both < INACTIVE))
            distinct, first, back = np.unique(key[at], return_index=True, return_inverse=True)
            count = np.bincount(back[at < own], minlength=len(distinct))
            now = counted(both[at[first]]) & (count > 0)
            keep(2, distinct[now], count[now], at[first][now])
            of_pair = np.full(max(n, 1), INACTIVE, np.uint8)
            of_pair[at] = pairs.look_up(distinct)[0][back]
            at = np.flatnonzero(counted(np.maximum(of_pair[:-1], of_pair[1:]))[: min(own, max(n - 2, 0))])
            distinct, first, count = np.unique(tokens.mix(key[at] * _STEP + block.hashes[at + 2]), return_index=True, return_counts=True)
            keep(3, distinct, count, at[first])
            if sum(len(p[0]) for parts in found.values() for p in parts) > FLUSH:
                yield from flush()
        yield from flush()

    return run


def _added(folder: str, state: State, step: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """A range's counts with those of a scan: written, with the arrays of the active phrases."""

    def run(t: pa.Table) -> pa.Table:
        length, r = t.column("length")[0].as_py(), t.column("range")[0].as_py()
        parts = [unpack(x.as_py()) for x in t.column("entries")]
        parts = [[*p, np.full(len(p[0]), INACTIVE, np.int64)] for p in parts]
        if (length, r) in state:
            parts.append(unpack(get_array(folder, state[length, r][0], np.uint8).tobytes()))
        key, count, place, since = _merged(parts)
        since[(since == INACTIVE) & (count >= least)] = step + 1
        on = since < INACTIVE
        files = [put_array(folder, name, x) for name, x in (("all", np.frombuffer(pack(key, count, place, since), np.uint8)), ("key", key[on]), ("since", since[on].astype(np.uint8)), ("count", count[on]))]
        last = int(since[on].max()) if on.any() else 0
        return pa.table({"length": pa.array([length], pa.int32()), "range": pa.array([r], pa.int32()), "last": pa.array([last], pa.int32()), "files": pa.array([files], pa.list_(pa.string()))})

    return run


def _delete(spark: SparkSession, folder: str, names: list[str]) -> None:
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), False)


def count_phrases(blocks: list[DataFrame], folder: str, ranges: int, least: int) -> State:
    """Cyclic scans of the shards until every phrase has been counted over all of them."""
    state, last, step, shards = State(), {}, 0, len(blocks)
    while step < max(shards, *(shards + since for length, since in last.items() if length < LONGEST), 0):
        rows = blocks[step % shards].select("block", "own", "size", "n_words", "hashes", "places", "breaks")
        counts = rows.mapInArrow(_scan(folder, State(state), ranges, step, shards), "length int, range int, entries binary")
        added = counts.groupBy("length", "range").applyInArrow(_added(folder, State(state), step, least), "length int, range int, last int, files array<string>")
        old = []
        for r in added.collect():
            old += state.get((r["length"], r["range"]), [])
            state[r["length"], r["range"]] = r["files"]
            last[r["length"]] = max(last.get(r["length"], 0), r["last"])
        _delete(blocks[0].sparkSession, folder, old)
        step += 1
    return state


def _candidates(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(length, count, block, place) of the active phrases of ranges' files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, count, place, since = unpack(get_array(folder, row["file"], np.uint8).tobytes())
            on = since < INACTIVE
            yield pa.RecordBatch.from_arrays([pa.array([row["length"]] * int(on.sum()), pa.int32()), pa.array(count[on]), pa.array(place[on] >> BITS), pa.array((place[on] & (BLOCK - 1)).astype(np.int32))], names=["length", "count", "block", "place"])

    return run


def _write_places(folder: str) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        files = [put_array(folder, name, t.column(name).to_numpy()) for name in ("block", "place", "length", "count")]
        return pa.table({"part": t.column("part")[:1], "files": pa.array([files], pa.list_(pa.string()))})

    return run


def least_score(a: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, l, r) of the cut with the lowest floor(10**6 * a * a / (l * r)), the first of equals; exact."""
    most = max((int(x.max()) for x in (a, *(x for cut in cuts for x in cut)) if len(x)), default=0)
    # 10**6 * a * a and l * r are below 2**63 where all counts are below 3 million
    kind = np.int64 if most < 3_000_000 else object
    scores = np.array([10**6 * a.astype(kind) * a.astype(kind) // (left.astype(kind) * right.astype(kind)) for left, right in cuts])
    pick, each = scores.argmin(axis=0), np.arange(len(a))
    return scores[pick, each].astype(np.int64), *(np.array(x)[pick, each] for x in zip(*cuts, strict=True))


_PHRASES = "length int, lang string, phrase string, a long, l long, r long, score long, left long, right long"


def _read_phrases(folder: str, places: dict[int, list[str]], parts: int, state: State, ranges: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The candidates whose place is in a block, with their words, their parts' counts and score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (state.active(folder, n, ranges) for n in (1, 2))
        for row in rows_of(batches):
            files = places.get(row["block"] % parts)
            if files is None:
                continue
            number, place, length, count = (get_array(folder, name, kind) for name, kind in zip(files, (np.int64, np.int32, np.int32, np.int64), strict=True))
            here = slice(*np.searchsorted(number, [row["block"], row["block"] + 1]))
            if here.start == here.stop:
                continue
            block = Block(row)
            raw = zstandard.ZstdDecompressor().decompress(row["words"])
            size = np.frombuffer(raw, "<u4", len(block.keys)).astype(np.int64)
            end = 4 * len(size) + np.cumsum(size)
            known = [raw[z - s : z] for z, s in zip(end.tolist(), size.tolist(), strict=True)]
            lang = [row["langs"][i] for i in _values(row["word_langs"], len(size)).tolist()]
            of_word = words.look_up(block.keys)[1]
            key = block.pairs()
            at_all, length_all, a_all = (np.array(x[here]) for x in (place, length, count))
            wanted = np.unique(np.concatenate([at_all, at_all[length_all == 3] + 1]))
            distinct, back = np.unique(key[np.minimum(wanted, len(key) - 1)], return_inverse=True)
            of_pair = np.zeros(len(block.places) + 1, np.int64)
            of_pair[wanted] = pairs.look_up(distinct)[1][back]
            for n in (2, 3):
                at, a = (x[length_all == n].astype(np.int64) for x in (at_all, a_all))
                if not len(at):
                    continue
                word = [block.places[at + i] for i in range(n)]
                cuts = [(of_word[word[0]], of_word[word[1]])] if n == 2 else [(of_word[word[0]], of_pair[at + 1]), (of_pair[at], of_word[word[2]])]
                score, left, right = least_score(a, cuts)
                texts = [b" ".join(known[i] for i in w).decode() for w in zip(*(w.tolist() for w in word), strict=True)]
                # a phrase of two is its own key; a phrase of three names the two that it holds
                keys = [key[at], key[at]] if n == 2 else [key[at], key[at + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.int32()), pa.array([lang[i] for i in word[0].tolist()], pa.string()), pa.array(texts, pa.string()), *(pa.array(x) for x in (a, left, right, score)), *(pa.array(x.view(np.int64)) for x in keys)], names=["length", "lang", "phrase", "a", "l", "r", "score", "left", "right"])

    return run


def phrases(docs: DataFrame, least: int = 10, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Every phrase of two or three words that occurs ``least`` times, stored, as (length, lang,
    phrase, a, l, r, score, left, right), and each lang's number of words (lang, n)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    path = new_folder(spark, "blocks")
    cut = rows.mapInArrow(_blocks(shards), _BLOCKS)
    cut.write.partitionBy("shard").parquet(path)
    all_blocks = spark.read.schema(cut.schema).parquet(path)
    blocks = [all_blocks.filter(F.col("shard") == s) for s in range(shards)]
    in_langs = all_blocks.select(F.explode(F.arrays_zip("langs", "lang_counts")).alias("x"))
    totals = stored(in_langs.groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_counts").alias("n")).filter("n > 0"), "lang-totals")
    n = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, 1 << max(0, (n // PER_RANGE)).bit_length())
    folder = new_folder(spark, "phrase-counts")
    state = count_phrases(blocks, folder, ranges, least)
    files = spark.createDataFrame([(length, x[0]) for (length, _), x in state.items() if length > 1], "length int, file string")
    found = files.repartition(max(1, files.count()), "file").mapInArrow(_candidates(folder), "length int, count long, block long, place int")
    placed = found.withColumn("part", F.pmod("block", F.lit(ranges))).groupBy("part").applyInArrow(_write_places(folder), "part long, files array<string>")
    places = {r["part"]: r["files"] for r in placed.collect()}
    return stored(all_blocks.drop("shard").mapInArrow(_read_phrases(folder, places, ranges, State(state), ranges), _PHRASES), "phrases"), totals


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000, shards: int = SHARDS) -> DataFrame:
    """Each lang's first ``most`` collocations: (lang, rank, phrase, a, l, r, n, score).

    Without phrases that some longer phrase holds in ``share`` per cent of their
    occurrences or more.  Order: score, then count, highest first, then the phrase."""
    found, totals = phrases(docs, least, shards)
    longer = found.filter("length = 3").select(F.explode(F.array("left", "right")).alias("left"), "a").groupBy("left").agg(F.max("a").alias("longer"))
    pairs = found.filter("length = 2").join(longer, "left", "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    out = pairs.select(*columns).unionByName(found.filter("length = 3").select(*columns))
    out = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        out = out.withColumn("rank", rank).filter(F.col("rank") <= most)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
