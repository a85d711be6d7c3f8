"""Documents packed into sequences by reciprocal-capacity classes (operator 12).

Harmonic packing: a piece of length l belongs to class i = capacity // l, and a
bin of class i takes exactly i pieces of that class.  Which pieces a document is
cut into depends on its length alone (``cuts``): full sequences first; what is
left stays whole where i pieces of its length fill a bin up to ``SLACK`` of its
capacity, else its head is cut to the largest length of which i + 1 fill one.
So every task cuts and numbers its pieces by itself, class by class.

1. Every task encodes its texts, cuts them, and numbers its pieces per class.
2. Numbers of tasks' pieces per class, summed up in the order of tasks, make the
   numbers run through; i pieces in a row are a bin.  Pieces are shuffled by bin,
   so a class however large is spread, and no task holds more than a bin at once.
3. The last bin of a class is often not full.  What those bins hold, fewer than i
   pieces per class whatever the input's size, goes to one task that packs it
   longest first into the fullest bin with room.  Last bins of one class only that
   are full enough come out of that unchanged.

Each distinct part of a word is encoded once per task: the tokenizer drops white
space, and no step of it reaches across it or across the cuts that it makes.

Null texts count as empty: a document is at least its closing id.  Every row is
a document of its own: rows that share a doc_id are packed each, null ids too.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import slice_rows, stored, texts

CAPACITY = 4096
#: Share of a bin that i pieces of a length may leave empty, before it is cut.
SLACK = 1 / 64
#: Distinct parts of words that a task remembers, and the characters of the longest of them.
MEMORY, LONGEST = 600_000, 64

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, class int, place long"


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces, in order, that a document of so many ids is cut into."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        fit = capacity // rest
        if capacity - fit * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (fit + 1))
        rest -= out[-1]
    return out


#: A word of its own whose id no other word's ids hold: it parts words that are encoded together.
PART = "\x00"
_WHITE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _latin_classes() -> np.ndarray:
    """Class of the Latin-1 code points; 256 stands for all others.  Odd are those that normal
    form, lower case or white space of the tokenizer treat in ways of their own."""
    out = np.full(257, _OTHER, np.uint8)
    for i in range(256):
        c = chr(i)
        out[i] = _LETTER if c.isalpha() else _DIGIT if unicodedata.category(c)[0] == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32]] = _WHITE
    out[[0, 0x85, 0xA0, 256]] = _ODD
    return out


_CLASSES = _latin_classes()
_LOWER = np.array([*(ord(chr(i).lower()) for i in range(256)), 256], np.uint32)


def _word_parts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, odd) of the tokenizer's cuts of words: runs of letters, single digits, runs
    of others, and short endings behind an apostrophe; a word with an odd character is one."""
    kind = _CLASSES[np.minimum(code, 256)]
    n, inside = len(code), kind != _WHITE
    before = np.r_[np.uint8(_WHITE), kind[:-1]]
    begins = inside & (before == _WHITE)
    word = np.cumsum(begins) - 1
    odd = np.zeros(int(begins.sum()), bool)
    odd[word[kind == _ODD]] = True
    out = inside & ((kind != before) | (kind == _DIGIT))
    at = np.flatnonzero((code == 39) & out)
    c1, c2 = (np.where(at + k < n, code[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
    c1, c2 = (_LOWER[np.minimum(c, 256)].astype(np.int64) for c in (c1, c2))
    short = np.isin(c1, [ord(c) for c in "stmd"])
    long = np.isin(c1 << 32 | c2, [ord(c) << 32 | ord(d) for c, d in ("re", "ve", "ll")])
    for hit, size in ((at[short], 2), (at[long], 3)):
        for k in range(1, size):
            out[hit + k] = False
        rest = hit[hit + size < n] + size
        out[rest] |= inside[rest]
    if odd.any():
        out = np.where(inside & odd[np.maximum(word, 0)], begins, out)
    start = np.flatnonzero(out)
    # a part ends where the next begins, or before that at white space
    gaps = np.flatnonzero(~inside)
    stop = np.r_[gaps, n][np.searchsorted(gaps, start)]
    return start, np.minimum(np.r_[start[1:], n], stop), odd[word[start]] if len(start) else np.empty(0, bool)


class Encoder:
    """Ids of texts; what the tokenizer cuts words into is encoded once each, new ones together.

    Latin-1 words are cut here, as the tokenizer does; words with other characters are left
    to it whole.  Parts and words are told apart by 64-bit hashes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[int, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, names: list[int], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Name k has the ids up to ends[k]; gap ids lie between two."""
        raw, at = ids.tobytes(), 0
        for name, end in zip(names, (4 * ends).tolist(), strict=True):
            self.known[name] = raw[at:end]
            at = end + 4 * gap

    def _learn_parts(self, parts: dict[int, str]) -> None:
        ids = self._ids(" ".join(parts.values()))
        self._learn(list(parts), ids, np.flatnonzero(self.closes[ids]) + 1, 0)

    def _learn_words(self, words: dict[int, str]) -> None:
        plain = {k: w for k, w in words.items() if PART not in w}
        ids = self._ids(f" {PART} ".join([*plain.values(), ""]))
        self._learn(list(plain), ids, np.flatnonzero(ids == self._ids(PART)[0]), 1)
        self.known.update((k, self._ids(w).tobytes()) for k, w in words.items() if PART in w)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text i are ids[first[i]:first[i + 1]]."""
        whole = "\n".join([*texts, ""])
        code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        start, end, odd = _word_parts(code)
        # odd words by their characters, parts by their lower case
        low = _LOWER[np.minimum(code, 256)]
        h = tokens.run_hashes(low, start, end)
        h[odd] = tokens.mix(tokens.run_hashes(code, start[odd], end[odd]))
        keys, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.known.clear()
        keys, fresh = keys.tolist(), ({}, {})
        for k, a, z, o in zip(keys, start[one].tolist(), end[one].tolist(), odd[one].tolist(), strict=True):
            if k not in self.known:
                fresh[o][k] = whole[a:z]
        self._learn_parts(fresh[0])
        self._learn_words(fresh[1])
        found = list(map(self.known.__getitem__, keys))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")[tokens.ragged((np.cumsum(size) - size)[back], size[back])]
        for words in fresh:
            for k, w in words.items():
                if len(w) > LONGEST:
                    del self.known[k]
        text = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return ids, np.r_[0, np.cumsum(size[back])][np.searchsorted(start, text)]


def _cut(path: str, closing: int, capacity: int, slack: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, end = TaskContext.get().partitionId(), Encoder(path), np.array([closing], "<u4").tobytes()
        numbered: dict[int, int] = {}
        planned: dict[int, list[int]] = {}
        for b in (part for whole in batches for part in slice_rows(whole, 8 << 20)):
            out: list[list] = [[] for _ in range(7)]
            all_ids, first = encoder.encoded(b.column("text").to_pylist())
            for doc, begin, close in zip(b.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                ids = all_ids[begin:close].tobytes() + end
                total, start = len(ids) // 4, 0
                # whole sequences and a rest that depends on its length only: few distinct plans
                rest = total % capacity
                if rest not in planned:
                    planned[rest] = cuts(rest, capacity, slack)
                for length in [capacity] * (total // capacity) + planned[rest]:
                    kind = capacity // length
                    place = numbered[kind] = numbered.get(kind, -1) + 1
                    for column, value in zip(out, (doc, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), total, kind, place), strict=True):
                        column.append(value)
                    start += length
            doc_id, begins, length, crc, totals, kind, place = out
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(begins, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(totals, pa.int64()), pa.array([task] * len(length), pa.int32()), pa.array(kind, pa.int32()), pa.array(place, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "class", "place"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, closing_id: int = 2, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """Every document's pieces, stored: (doc_id, start, length, ids_crc32, doc_tokens), and
    the task's number with the piece's class and place among the task's pieces of it."""
    return stored(texts(docs).mapInArrow(_cut(tokenizer_path, closing_id, capacity, slack), _PIECES), "pieces")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each length: longest first, into the fullest bin with room for it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    out, bins = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        left = next((r for r in range(lengths[i], capacity) if room[r]), None)
        if left is None:
            out[i], left, bins = bins, capacity, bins + 1
        else:
            out[i] = room[left].pop()
        room[left - lengths[i]].append(out[i])
    return out


def _rest_packed(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        order = sorted(range(t.num_rows), key=list(zip(t.column("class").to_pylist(), t.column("number").to_pylist(), strict=True)).__getitem__)
        t = t.drop_columns(["all"]).take(pa.array(order, pa.int64()))
        bins = best_fit(t.column("length").to_pylist(), capacity)
        return t.append_column("bin", pa.array(bins, pa.int64()))

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces as (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    counts = cut.groupBy("task", "class").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("class")).alias("all"))
    numbered = cut.join(offsets, ["task", "class"]).withColumn("number", F.col("before") + F.col("place"))
    whole = F.col("number") < F.col("all") - F.col("all") % F.col("class")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "number"]
    # bins of class i are numbered i, i + capacity + 1, ...; those of the rest 0, capacity + 1, ...
    full = numbered.filter(whole).select(*columns, (F.floor(F.col("number") / F.col("class")) * (capacity + 1) + F.col("class")).cast("long").alias("sequence_id"))
    kept = ", ".join(f"{c} {t}" for c, t in cut.select(*columns[:-1]).dtypes) + ", number long, bin long"
    rest = numbered.filter(~whole).select(*columns, F.lit(0).alias("all")).groupBy("all").applyInArrow(_rest_packed(capacity), kept)
    rest = rest.select(*columns, (F.col("bin") * (capacity + 1)).alias("sequence_id"))
    place = Window.partitionBy("sequence_id").orderBy("class", "number").rowsBetween(Window.unboundedPreceding, -1)
    out = full.unionByName(rest).withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0)).cast("long"))
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed(docs: DataFrame, tokenizer_path: str, closing_id: int = 2, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return pack(pieces(docs, tokenizer_path, closing_id, capacity, slack), capacity)
