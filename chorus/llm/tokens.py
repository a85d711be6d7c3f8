"""Word hashing over Arrow string columns, without a Python object per word.

A column's UTF-8 bytes are read as one numpy array; separators come from a
256-entry table, and each word's 64-bit hash from one running sum of
``code[byte] * P**position`` (the sum over a word, times ``P**-start``, depends
on the word alone).  All separators used here are ASCII, so cutting bytes is
the same as cutting code points.  Texts of any length are handled in pieces
that end at a separator or at a text's end, so the work space stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_bytes = np.arange(256)
#: ASCII white space, [\x20\x09-\x0D].
WHITE = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
#: All ASCII but digits and lower-case letters: [\x00-\x2F\x3A-\x60\x7B-\x7F].
NOT_ALNUM = (_bytes < 0x80) & ~((_bytes >= 0x30) & (_bytes <= 0x39)) & ~((_bytes >= 0x61) & (_bytes <= 0x7A))
#: A-Z to a-z, other bytes unchanged.
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end at a text's end or behind a separator."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            last = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if last > at:
                end = last
            else:
                found, look = -1, end
                while found < 0 and look < n:
                    ahead = np.flatnonzero(separators[data[look : look + PIECE]])
                    found = look + int(ahead[0]) + 1 if len(ahead) else -1
                    look += PIECE
                following = int(offsets[np.searchsorted(offsets, at, "right")])
                end = min(found if found > 0 else n, following)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, table: np.ndarray = LOWER, heads: list[tuple[int, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): a row per word, A-Z lower-cased, in order;
    first[i]:first[i + 1] are the words of text i.  table maps bytes before all
    else; heads, pairs of a length and an empty array, get the hashes of the words'
    first bytes, 0 for words that are not longer."""
    hashes, starts, ends = [], [], []
    begun: list[list[np.ndarray]] = [[] for _ in heads or ()]
    power, inverse = _tables(1)
    for a, b in _cuts(data, offsets, separators):
        power, inverse = _tables(b - a + 1)
        low = table[data[a:b]]
        inside = ~separators[low]
        edges = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[edges] = inside[edges]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        before = edges[edges > 0] - 1
        finish[before] = inside[before]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_CODES[low] * power[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        for (length, _), found in zip(heads or (), begun, strict=True):
            cut = np.minimum(s + length, e)
            found.append(np.where(e - s > length, mix((total[cut] - total[s]) * inverse[s] + np.uint64(length + (1 << 20))), np.uint64(0)))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    for i, found in enumerate(begun):
        heads[i] = (heads[i][0], np.concatenate(found))
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def run_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs start[i]:end[i] of an array of code points; the runs ascend.

    The same running sum as in words(), over pieces that end where a run ends."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        low = int(start[at])
        last = max(at + 1, int(np.searchsorted(end, low + PIECE, "right")))
        high = int(end[last - 1])
        power, inverse = _tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(mix(code[low:high].astype(np.uint64) + np.uint64(_P & 0xFFFFFFFF)) * power[: high - low], out=total[1:])
        s, e = start[at:last] - low, end[at:last] - low
        out[at:last] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = last
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs that start at each word (the last n - 1 words start none)."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(out)])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: for 64-bit hashes several times as fast as numpy's
    unique(), which hashes them first."""
    found = np.sort(values)
    new = np.empty(len(found), bool)
    new[:1] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one text; with fewer words, the whole sequence as one."""
    if not len(hashes):
        return hashes
    return distinct(shingles(hashes, min(n, len(hashes))) + np.uint64(len(hashes) if len(hashes) < n else 0))


def slices(column, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about most_bytes each, one row at least."""
    _, offsets = string_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def lengths_to_index(counts: np.ndarray) -> np.ndarray:
    """0 counts[0] times, 1 counts[1] times, and so on."""
    return np.repeat(np.arange(len(counts)), counts)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
