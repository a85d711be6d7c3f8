"""Language identification by character language models (operator 4).

For every language an interpolated modified Kneser-Ney model of the characters:
letters lower-cased, each run of other characters one space.  Four characters
of 16 bits make a 64-bit key (code points above 0xFFFF are hashed to 16 bits).
Spark counts the keys of all learning texts per task and language; one task per
language merges the packed counts and writes sorted arrays with the interpolated
probabilities of every order and the weights of the contexts.  Workers memory-map them;
a text's language is the one with the lowest cross-entropy per character.

The evidence for a decision (its lead over the runner-up, in nats) is calibrated
on the learning texts: the share of right decisions, made monotone over bins of
the evidence, is the score, and decisions below ``reject_below`` become ``und``.

Null texts and texts without a letter: ``und`` with score 0.  Without any
learning text everything is ``und``.  Equal entropies: the first language in
order of name.  Rows are independent; repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import get_array, merge_counts, new_folder, pack, put_array, slice_rows, stored, unpack
from chorus.llm.quality import isotonic
from chorus.llm.tokens import lengths_to_index, string_bytes

ORDER = 4
UNKNOWN = "und"
BINS = 200
_SPACE = 32
_MOST_EVIDENCE = 20.0


def _symbols() -> np.ndarray:
    """Code point to symbol: a letter's lower case in 16 bits, else a space."""
    table = np.full(0x110000, _SPACE, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[i] = low if low < 0x10000 else low * 40503 & 0xFFFF
    return table


_table: list[np.ndarray] = []


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): a key per letter or space of each text, with the three symbols
    before it; texts begin after spaces and end with one.  No letter: no keys."""
    if not _table:
        _table.append(_symbols())
    data, offsets = string_bytes(column)
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    sym, doc = _table[0][points], lengths_to_index(np.diff(heads[offsets]))
    blank = sym == _SPACE
    keep = ~blank
    if len(sym):
        keep[1:] |= blank[1:] & ~blank[:-1] & (doc[1:] == doc[:-1])
    lettered = np.bincount(doc, ~blank, minlength=n) > 0
    keep &= lettered[doc]
    sym, doc = sym[keep], doc[keep]
    tail = np.zeros(n, bool)  # texts whose last symbol is no space get one
    if len(sym):
        last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
        tail[doc[last]] = sym[last] != _SPACE
    sizes = np.bincount(doc, minlength=n) + tail
    first = np.r_[0, np.cumsum(sizes)]
    stream = np.full(first[-1] + (ORDER - 1) * n, _SPACE, np.uint64)
    begin = first[:-1] + (ORDER - 1) * np.arange(1, n + 1)
    stream[begin[doc] + np.arange(len(doc)) - np.r_[0, np.cumsum(np.bincount(doc, minlength=n))][:-1][doc]] = sym
    ends = lengths_to_index(sizes)
    at = np.arange(first[-1]) + (ORDER - 1) * (ends + 1)
    keys = stream[at]
    for k in range(1, ORDER):
        keys |= stream[at - k] << np.uint64(16 * k)
    return keys, first


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for b in batches:
        for part in slice_rows(b):
            keys, first = grams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            of = langs[lengths_to_index(np.diff(first))]
            for lang in np.unique(langs):
                k, c = np.unique(keys[of == lang], return_counts=True)
                old = held.get(lang)
                held[lang] = list(merge_counts([old[0], k], [old[1], c])) if old else [k, c]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pack(k, c) for k, c in held.values()], pa.binary())], names=["lang", "counts"])


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n = [max(1.0, float((counts == k).sum())) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))])


def _orders(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From order 1 up: (keys, probability, contexts, weight of the lower order)."""
    levels = [(keys, counts)]
    for k in range(ORDER - 1, 0, -1):
        suffix = np.sort(levels[-1][0] & np.uint64((1 << 16 * k) - 1))
        levels.append(np.unique(suffix, return_counts=True))
    out: list[tuple] = []
    for k, (key, count) in enumerate(reversed(levels), 1):
        context = key >> np.uint64(16) if k > 1 else np.zeros(len(key), np.uint64)
        begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        cut = _discounts(count)[np.minimum(count, 3)]
        total, held = np.add.reduceat(count, begin), np.add.reduceat(cut, begin)
        of = lengths_to_index(np.diff(np.r_[begin, len(key)]))
        weight = held / total
        lower = out[-1][1][np.searchsorted(out[-1][0], key & np.uint64((1 << 16 * (k - 1)) - 1))] if out else np.full(len(key), 1 / (len(key) + 1))
        out.append((key, (count - cut) / total[of] + weight[of] * lower, context[begin], weight))
    return out


def _model(folder: str):
    def run(t: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in t.column("counts")]
        while len(parts) > 1:
            parts = [list(merge_counts([a[0], b[0]], [a[1], b[1]])) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
        names = []
        if len(parts[0][0]):
            for key, p, context, weight in _orders(*parts[0]):
                names += [put_array(folder, "keys", key), put_array(folder, "p", np.log(p).astype(np.float32)), put_array(folder, "contexts", context), put_array(folder, "weights", np.log(weight).astype(np.float32))]
        return pa.table({"lang": t.column("lang")[:1], "files": pa.array([names], pa.list_(pa.string()))})

    return run


def train(docs: DataFrame, lang: str = "lang") -> dict:
    """Models of docs' languages, from all of their texts: {"folder", "files": {lang: names}}."""
    folder = new_folder(docs.sparkSession, "language-model")
    rows = docs.filter(F.col(lang).isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col(lang).alias("lang"))
    made = rows.mapInArrow(_counts, "lang string, counts binary").groupBy("lang").applyInArrow(_model(folder), "lang string, files array<string>").collect()
    return {"folder": folder, "files": {r["lang"]: list(r["files"]) for r in sorted(made, key=lambda r: r["lang"]) if r["files"]}}


class _Reader:
    """One language's arrays, memory-mapped; log probabilities of keys."""

    def __init__(self, folder: str, files: list[str]):
        kinds = (np.uint64, np.float32, np.uint64, np.float32)
        self.orders = [tuple(get_array(folder, f, kind) for f, kind in zip(files[i : i + 4], kinds, strict=True)) for i in range(0, len(files), 4)]
        self.floor = float(np.log(1 / (len(self.orders[0][0]) + 1)))

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """keys: sorted, distinct."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(len(self.orders), 0, -1):
            key, p, context, weight = self.orders[k - 1]
            mine = keys[left] & np.uint64((1 << 16 * k) - 1)
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = key[at] == mine
            out[left[hit]] += p[at[hit]]
            left, mine = left[~hit], mine[~hit] >> np.uint64(16) if k > 1 else np.zeros((~hit).sum(), np.uint64)
            at = np.minimum(np.searchsorted(context, mine), len(context) - 1)
            out[left] += np.where(context[at] == mine, weight[at], 0.0)
        out[left] += self.floor
        return out


def _decide(model: dict):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(model["files"])
        readers = [_Reader(model["folder"], model["files"][x]) for x in langs]
        for b in batches:
            for part in slice_rows(b):
                n = part.num_rows
                best, lead, length = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
                keys, first = grams(part.column("text"))
                if readers and len(keys):
                    distinct, back = np.unique(keys, return_inverse=True)
                    length = np.diff(first)
                    of = lengths_to_index(length)
                    logs = np.stack([np.bincount(of, r.log_p(distinct)[back], minlength=n) for r in readers], axis=1)
                    entropy = -logs / np.maximum(length, 1)[:, None]
                    top = entropy.argmin(axis=1)
                    best = [langs[t] if size else UNKNOWN for t, size in zip(top, length, strict=True)]
                    if len(langs) > 1:
                        low = np.sort(entropy, axis=1)
                        lead = np.minimum((low[:, 1] - low[:, 0]) * length, np.exp(_MOST_EVIDENCE))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(best, pa.string()), pa.array(np.log1p(lead)), pa.array(length, pa.int64()), part.column("lang"), part.column("learns")], names=["doc_id", "lang_pred", "evidence", "symbols", "lang", "learns"])

    return run


def identify(docs: DataFrame, learns: Column | None = None, lang: str = "lang", reject_below: float = 0.0) -> DataFrame:
    """Every row of docs as (doc_id, lang_pred, score), learnt from the rows that satisfy learns."""
    learns = F.lit(True) if learns is None else learns
    model = train(docs.filter(learns), lang)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(lang).alias("lang"), learns.alias("learns"))
    made = stored(rows.mapInArrow(_decide(model), "doc_id long, lang_pred string, evidence double, symbols long, lang string, learns boolean"), "language-decisions")
    bin_ = F.least(F.lit(BINS - 1), F.floor(F.col("evidence") / _MOST_EVIDENCE * BINS)).cast("int")
    seen = made.filter("learns and lang is not null and symbols > 0").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).orderBy("bin").collect()
    x, level = isotonic(np.array([(r["bin"] + 0.5) * _MOST_EVIDENCE / BINS for r in seen]), np.array([r["n"] + 1.0 for r in seen]), np.array([(r["right"] + 0.5) / (r["n"] + 1) for r in seen]))

    def calibrate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            evidence, symbols = b.column("evidence").to_numpy(), b.column("symbols").to_numpy()
            score = np.where(symbols > 0, np.interp(evidence, x, level) if len(x) else 0.0, 0.0)
            named = [p if s >= reject_below else UNKNOWN for p, s in zip(b.column("lang_pred").to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return made.mapInArrow(calibrate, "doc_id long, lang_pred string, score double")
