"""Byte-level BPE by a global shuffle of distinct words (operator 7).

Encoding:

1. Every task splits its texts by the tokenizer's pattern, in blocks of some
   megabytes.  A block keeps, for each document, the sequence of its pre-tokens
   as positions in the block's list of distinct words.
2. The distinct words of all blocks are shuffled by their hash, so all copies of
   a word meet in one task, which merges its bytes into ids once.
3. The ids go back to the blocks that asked, and meet the positions there:
   each document's ids are read off in order.

Only the distinct words of a block travel, never their occurrences, so a very
frequent word is one entry per block.  Words and positions are packed arrays
under zstd.  Decoding joins ids to the table of the tokens' bytes.

Null texts count as empty: no ids.  Rows are independent (a repeated doc_id
gives a row each time); other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from chorus.llm import tokens
from chorus.llm.common import _planes, _values, texts

BLOCK_CHARS = 8 << 20
#: A block is cut into pre-tokens, and its documents are put together, so many characters or
#: pre-tokens at a time: what a worker touches once it keeps, and executors keep their workers.
SLICE = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 100:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs over linked parts, for words of any length."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [ranks[p] for p in parts if p is not None]


#: The pattern that numpy cuts by (fixed value); any other one goes to the regex engine.
BY_CLASS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def cuts_by_class(code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a pre-token of BY_CLASS begins at each code point of texts laid one after another.

    begins: whether a text begins there.  A pre-token is a run of one class with the blank
    before it; of white space before it, the last character goes to it (a blank) or stands
    alone; an apostrophe that opens a pre-token takes a short ending with it."""
    n, kind = len(code), _classes()[code]
    ends = np.r_[begins[1:], True]
    before, after = np.r_[np.uint8(_SPACE), kind[:-1]], np.r_[kind[1:], np.uint8(_SPACE)]
    blank_before = np.r_[False, code[:-1] == 32] & ~begins
    space = kind == _SPACE
    out = begins | ((kind != before) & ~blank_before)
    # of a run of white space, only its first and, before a word, its last character begin
    out[space] = (begins | (before != _SPACE) | (~ends & (after != _SPACE)))[space]
    at = np.flatnonzero(code == 39)
    if len(at):
        # the texts' ends keep an ending from reaching into the next text
        one, two = at + 1 < n, at + 2 < n
        c1 = np.where(one & ~ends[at], code[np.minimum(at + 1, n - 1)], 0)
        c2 = np.where(two & ~ends[at] & ~ends[np.minimum(at + 1, n - 1)], code[np.minimum(at + 2, n - 1)], 0)
        opens = out[at] | (~begins[at] & ((before[at] == _LETTER) | (before[at] == _NUMBER)))
        short = opens & np.isin(c1, [ord(c) for c in "stmd"])
        long = opens & np.isin(c1.astype(np.int64) << 32 | c2, [ord(c) << 32 | ord(d) for c, d in ("re", "ve", "ll")])
        for hit, size in ((at[short], 2), (at[long], 3)):
            out[hit] = True
            for k in range(1, size):
                out[hit + k] = False
            rest = hit[hit + size < n] + size
            out[rest] |= ~blank_before[rest]
    return out


def _spans(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items of about SLICE in all, one item at least; item i spans ends[i]:ends[i + 1]."""
    at, n = 0, len(ends) - 1
    while at < n:
        last = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield at, last
        at = last


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each pre-token, pre-tokens per text, distinct pre-tokens) under BY_CLASS.

    Pre-tokens are told apart by 64-bit hashes of their code points.  No pre-token depends on
    another text, so some texts are cut at a time."""
    numbers, sizes, words = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], []
    # the sorted hashes of the words so far, and the words' numbers
    known, known_as = np.empty(0, np.uint64), np.empty(0, np.uint32)
    for a, z in _spans(np.cumsum([0, *map(len, texts)])):
        whole = "".join(texts[a:z])
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum([0, *map(len, texts[a:z])])
        if not len(code):
            sizes.append(np.zeros(z - a, np.int64))
            continue
        begins = np.zeros(len(code), bool)
        begins[first[:-1][first[:-1] < len(code)]] = True
        start = np.flatnonzero(cuts_by_class(code, begins))
        end = np.r_[start[1:], len(code)]
        found, one, inverse = np.unique(tokens.run_hashes(code, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(known, found)
        new = np.ones(len(found), bool)
        inside = place < len(known)
        new[inside] = known[place[inside]] != found[inside]
        number = np.empty(len(found), np.uint32)
        number[~new] = known_as[place[~new]]
        number[new] = np.arange(len(words), len(words) + int(new.sum()))
        words += [whole[i:j] for i, j in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
        known, known_as = np.insert(known, place[new], found[new]), np.insert(known_as, place[new], number[new])
        numbers.append(number[inverse])
        sizes.append(np.diff(np.searchsorted(start, first)))
    return np.concatenate(numbers), np.concatenate(sizes), words


def _split(texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each pre-token, pre-tokens per text, distinct pre-tokens)."""
    if pattern == BY_CLASS:
        return _numbered(texts)
    found = [regex.findall(pattern, t) for t in texts]
    words: dict[str, int] = {}
    numbers = [words.setdefault(w, len(words)) for f in found for w in f]
    return np.array(numbers, np.uint32), np.array([len(f) for f in found], np.int64), list(words)


def _blocks(batches: Iterable[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, list[int], list[int], np.ndarray, list[str]]]:
    """(block id, doc_ids, pre-tokens per document, positions, distinct words)."""
    ids: list[int] = []
    held: list[str] = []
    chars, name = 0, xxhash.xxh3_64()

    def block():
        positions, sizes, words = _split(held, pattern)
        return name.intdigest() >> 1, ids, sizes.tolist(), positions, words

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            if ids and chars + len(text) > BLOCK_CHARS:
                yield block()
                ids, held, chars, name = [], [], 0, xxhash.xxh3_64()
            held.append(text)
            ids.append(doc_id)
            chars += len(text)
            name.update(f"{doc_id} ".encode())
            name.update(text.encode())
    if ids:
        yield block()


def _in_order(words: list[str], shards: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A block's words in the order of asking, by shard and then bytes: (place in the block,
    shard, bytes)."""
    encoded = [w.encode() for w in words]
    shard = np.fromiter(map(xxhash.xxh3_64_intdigest, encoded), np.uint64, len(encoded)) % np.uint64(shards)
    by_bytes = np.array(sorted(range(len(encoded)), key=encoded.__getitem__), np.int64)
    place = by_bytes[np.argsort(shard[by_bytes], kind="stable")]
    return place, shard[place].astype(np.int64), [encoded[i] for i in place.tolist()]


def _asked(pattern: str, shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(shard, block, words): the block's distinct words of a shard, with their places in its list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for name, _, _, _, words in _blocks(batches, pattern):
            _, shard, encoded = _in_order(words, shards)
            cut = np.searchsorted(shard, np.arange(shards + 1)).tolist()
            used = [s for s in range(shards) if cut[s] < cut[s + 1]]
            packed = []
            for s in used:
                mine = encoded[cut[s] : cut[s + 1]]
                packed.append(press.compress(np.array([len(mine), *map(len, mine)], "<u4").tobytes() + b"".join(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([name] * len(used), pa.int64()), pa.array(packed, pa.binary())], names=["shard", "block", "words"])

    return run


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 4 * n + np.r_[0, np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))]
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _answered(path: str) -> Callable[[pa.Table], pa.Table]:
    """(shard, block, n_words, ids): each distinct word of the shard merged once, the answers in the order asked."""

    def run(t: pa.Table) -> pa.Table:
        ranks, known, out, asked = read_ranks(path), {}, [], []
        for blob in t.column("words"):
            ids, sizes = [], []
            for w in _unpack_words(blob.as_py()):
                found = known.get(w)
                if found is None:
                    found = known[w] = merge_word(w, ranks)
                ids += found
                sizes.append(len(found))
            asked.append(len(sizes))
            sizes, ids = _planes(np.array(sizes, np.uint64)), _planes(np.array(ids, np.uint64))
            out.append(np.array([len(sizes)], "<u4").tobytes() + sizes + ids)
        return pa.table({"shard": t.column("shard"), "block": t.column("block"), "n_words": pa.array(asked, pa.int64()), "ids": pa.array(out, pa.binary())})

    return run


def _positions(pattern: str, shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, docs, words, places): doc_ids with their sizes, and positions in the block's words as asked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, sizes, positions, words in _blocks(batches, pattern):
            common = np.bincount(positions, minlength=len(words)) if len(words) else np.empty(0, np.int64)
            # frequent words get small numbers, which pack better
            by_use = np.argsort(-common, kind="stable")
            number = np.empty(len(words), np.uint64)
            number[by_use] = np.arange(len(words))
            rank = np.empty(len(words), np.uint64)
            rank[_in_order(words, shards)[0]] = np.arange(len(words))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_planes(rank[by_use]) if len(words) else b""], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([_planes(number[positions])], pa.binary())], names=["block", "docs", "sizes", "order", "n_words", "places"])

    return run


def _assembled(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with their ids."""
    docs: list[int] = []
    ids_out: list[bytes] = []
    # equal blocks (repeated rows) ask the same words: one answer of each shard serves all
    answers = {s: (n, i) for s, n, i in zip(right.column("shard").to_pylist(), right.column("n_words").to_pylist(), right.column("ids").to_pylist(), strict=True)}
    ids, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n, blob in (answers[s] for s in sorted(answers)):
        cut = 4 + int(np.frombuffer(blob, "<u4", 1)[0])
        sizes.append(_values(blob[4:cut], n).astype(np.int64))
        ids.append(_values(blob[cut:], int(sizes[-1].sum())).astype(np.int64))
    flat, size = np.concatenate(ids).astype("<u4"), np.concatenate(sizes)
    start = np.cumsum(size) - size
    for row in left.to_pylist():
        n, n_docs = row["n_words"], row["sizes"]
        if n != len(size):
            raise ValueError("a block's words and positions come from different readings of its texts")
        total = sum(n_docs)
        places = _values(row["order"], n).astype(np.int64)[_values(row["places"], total).astype(np.int64)] if n else np.empty(0, np.int64)
        docs += row["docs"]
        begin = np.r_[0, np.cumsum(n_docs)].astype(np.int64)
        for a, z in _spans(begin):
            some = places[begin[a] : begin[z]]
            some_ids = flat[tokens.ragged(start[some], size[some])]
            ends = np.r_[0, np.cumsum(size[some])][begin[a : z + 1] - begin[a]]
            ids_out += [some_ids[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids_out, pa.binary())})


def _meeting(docs: DataFrame, ranks_path: str, pattern: str) -> PandasCogroupedOps:
    """The blocks' positions with the answers to their words, by block."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs)
    asked = rows.mapInArrow(_asked(pattern, shards), "shard int, block long, words binary")
    answered = asked.groupBy("shard").applyInArrow(_answered(ranks_path), "shard int, block long, n_words long, ids binary")
    placed = rows.mapInArrow(_positions(pattern, shards), "block long, docs array<long>, sizes array<long>, order binary, n_words long, places binary")
    return placed.groupBy("block").cogroup(answered.groupBy("block"))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every row of docs as (doc_id, ids): the ids as little-endian unsigned 32-bit integers."""
    return _meeting(docs, ranks_path, pattern).applyInArrow(_assembled, "doc_id long, ids binary")


def _bytes_of(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        start = np.cumsum(size) - size
        table = np.zeros(int(size.sum()), np.uint8)
        for token, i in ranks.items():
            table[start[i] : start[i] + size[i]] = np.frombuffer(token, np.uint8)
        for b in batches:
            out = []
            for ids in b.column("ids"):
                i = np.frombuffer(ids.as_py(), "<u4").astype(np.int64)
                out.append(table[tokens.ragged(start[i], size[i])].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) with the column decoded: the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_bytes_of(ranks_path), "doc_id long, ids binary, decoded binary")


def _assembled_and_decoded(path: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
        return pa.Table.from_batches(_bytes_of(path)(_assembled(left, right).to_batches()), schema)

    return run


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """decode(encode()) by the same steps, but a block's ids are decoded by the Python worker that
    put them together: one after the other, a task holds two workers, and executors keep them."""
    return _meeting(docs, ranks_path, pattern).applyInArrow(_assembled_and_decoded(ranks_path), "doc_id long, ids binary, decoded binary")
