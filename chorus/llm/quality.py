"""Quality scores by random Fourier features (operator 6).

Each text gives a row of statistics (lengths, shares of kinds of characters,
repetition).  Standardised, they pass through random Fourier features, which
approximate a Gaussian kernel; ridge regression on the labels then needs only
the features' normal equations.  Those are summed per task and per fold, then
by row of the matrix, so what reaches the driver is one matrix per fold of the
kernel's size whatever the corpus.  Scores that each fold gets from the other
folds' model calibrate the result: counts in fixed bins, made monotone by
pooling adjacent violators.

All labelled training rows are used.  Null texts count as empty and are scored
as such.  Several labels of one document: the largest counts.  With no label at
all (or an empty table of labels) nothing speaks against any text: the score is
1.  Columns besides ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import slice_rows, stored, texts

COMPONENTS = 256
RIDGE = 1.0
FOLDS = 3
BINS = 2000
SEED = 20240601
_LOW, _HIGH = -0.5, 1.5

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?",
    "bar": b"|", "symbol": b"#$%&*@^~=+<>/\\_{}[]", "blank": b" \t", "line": b"\n", "quote": b"\"'()-",
}
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_SETS.values(), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = len(_SETS) + 1
_CLASSES = len(_SETS) + 2

NAMES = ["log_words", "log_chars", "word_length", "word_spread", *(f"share_{k}" for k in _SETS), "share_other", "upper_of_letters", "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "distinct_lines", "words_per_line", "capital_words", "symbol_ends"]


def _ratio(a, b):
    return a / np.maximum(b, 1)


def statistics(column) -> np.ndarray:
    """A row of statistics per text, in the order of NAMES."""
    data, offsets = tokens.string_bytes(column)
    h, start, end, first = tokens.words(data, offsets)
    n = len(offsets) - 1
    kinds = _CLASS[data]
    row = tokens.lengths_to_index(np.diff(offsets))
    share = np.bincount(row * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    chars = np.diff(offsets).astype(float)
    words = np.diff(first).astype(float)
    of = tokens.lengths_to_index(np.diff(first))
    length = (end - start).astype(float)

    def per_text(x):
        return np.bincount(of, x, minlength=n)

    mean = _ratio(per_text(length), words)
    spread = np.sqrt(np.maximum(0, _ratio(per_text(length**2), words) - mean**2))
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    capital = (kinds[start] == 1) & (kinds[np.minimum(start + 1, end - 1)] == 1) & (length > 1) if len(h) else np.zeros(0)
    symbol = np.isin(kinds[end - 1], [5, 6, 7]) if len(h) else np.zeros(0)
    distinct, top, pairs, lines = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    at_line = np.flatnonzero(data == 10)
    line_of = np.searchsorted(at_line, start)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            _, c = np.unique(h[a:b], return_counts=True)
            distinct[i], top[i] = len(c) / (b - a), c.max() / (b - a)
            pairs[i] = len(tokens.distinct(tokens.shingles(h[a:b], 2))) / max(1, b - a - 1)
            new = np.flatnonzero(np.r_[True, line_of[a + 1 : b] != line_of[a : b - 1]])
            lines[i] = len(tokens.distinct(np.add.reduceat(h[a:b], new))) / len(new)
    out = [np.log1p(words), np.log1p(chars), mean, spread, *(_ratio(share[:, k], chars) for k in range(1, len(_SETS) + 1)), _ratio(share[:, 0], chars), _ratio(share[:, 1], share[:, 1] + share[:, 2]), distinct, top, _ratio(per_text(again), words), pairs, lines, np.log1p(_ratio(words, share[:, 9] + 1)), _ratio(per_text(capital), words), _ratio(per_text(symbol), words)]
    return np.stack(out, axis=1)


_COLUMNS = [f"s{i}" for i in range(len(NAMES))]


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slice_rows(b):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", *_COLUMNS])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, s0, s1, ...) of every row."""
    return texts(docs).mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{c} double" for c in _COLUMNS))


class Fourier(NamedTuple):
    """Standardising followed by random Fourier features, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(z), 1))])


class Model(NamedTuple):
    features: Fourier
    ridge: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.ridge, self.knots, self.levels), 0, 1)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS], axis=1)


def _normal_rows(features: Fourier):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            z, y, k = features(_matrix(b)), b.column("label").to_numpy().astype(float), b.column("part").to_numpy()
            for fold in np.unique(k):
                zf = z[k == fold]
                total[int(fold)] = total.get(int(fold), 0) + zf.T @ np.hstack([zf, y[k == fold][:, None]])
        for fold, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(m), pa.int32()), pa.array(np.arange(len(m)), pa.int32()), pa.array(list(m))], names=["part", "line", "sums"])

    return run


def _added(t: pa.Table) -> pa.Table:
    sums = np.sum([np.asarray(x, float) for x in t.column("sums").to_pylist()], axis=0)
    return pa.table({"part": t.column("part")[:1], "line": t.column("line")[:1], "sums": pa.array([sums])})


def _binned(features: Fourier, ridges: dict[int, np.ndarray]):
    """Bins of the scores that each row gets from the model without its fold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, k = features(_matrix(b)), b.column("part").to_numpy()
            s = np.sum([(z @ w) * (k == fold) for fold, w in ridges.items()], axis=0)
            bin_ = np.clip((s - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), b.column("label")], names=["bin", "label"])

    return run


def isotonic(x: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, level) of the non-decreasing fit: each block of pooled neighbours gives its two ends."""
    blocks: list[list[float]] = []
    for xi, w, m in zip(x, weight, mean, strict=True):
        blocks.append([xi, xi, w, m])
        while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
            a, b = blocks[-2], blocks.pop()
            blocks[-1] = [a[0], b[1], a[2] + b[2], (a[2] * a[3] + b[2] * b[3]) / (a[2] + b[2])]
    return np.array([e for b in blocks for e in b[:2]]), np.array([b[3] for b in blocks for _ in range(2)])


def _solve(m: np.ndarray) -> np.ndarray:
    penalty = np.eye(len(m)) * RIDGE
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(m[:, :-1] + penalty, m[:, -1])


def fit(statistics_: DataFrame, labels: DataFrame, label: str, learns: Column, components: int = COMPONENTS) -> Model | None:
    """Fitted on the rows of statistics_ that have a label and satisfy learns."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    train = stored(statistics_.filter(learns).join(known, "doc_id").withColumn("part", F.pmod(F.hash("doc_id"), F.lit(FOLDS))), "quality-train")
    moments = train.agg(F.count(F.lit(1)), *(F.avg(c) for c in _COLUMNS), *(F.stddev_pop(c) for c in _COLUMNS)).first()
    if not moments[0]:
        return None
    n, rng = len(_COLUMNS), np.random.default_rng(SEED)
    scale = np.array(moments[1 + n :], float)
    features = Fourier(np.array(moments[1 : 1 + n], float), np.where(scale > 1e-9, scale, 1), rng.normal(0, 1 / np.sqrt(n), (n, components)), rng.uniform(0, 2 * np.pi, components))
    schema = "part int, line int, sums array<double>"
    sums: dict[int, np.ndarray] = {}
    for r in train.mapInArrow(_normal_rows(features), schema).groupBy("part", "line").applyInArrow(_added, schema).collect():
        sums.setdefault(r["part"], np.zeros((components + 1, components + 2)))[r["line"]] = r["sums"]
    whole = np.sum(list(sums.values()), axis=0)
    ridges = {k: _solve(whole - m if len(sums) > 1 else whole) for k, m in sums.items()}
    bins = train.mapInArrow(_binned(features, ridges), "bin int, label int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).orderBy("bin").collect()
    centre = np.array([_LOW + (r["bin"] + 0.5) * (_HIGH - _LOW) / BINS for r in bins])
    return Model(features, _solve(whole), *isotonic(centre, np.array([r["n"] for r in bins], float), np.array([r["mean"] for r in bins], float)))


def scores(statistics_: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row of statistics_."""
    if model is None:
        return statistics_.select("doc_id", F.lit(1.0).alias("score"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b)))], names=["doc_id", "score"])

    return statistics_.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", learns: Column | None = None) -> DataFrame:
    """(doc_id, score) of every row of docs, learnt from the labelled rows that satisfy learns."""
    found = stored(document_statistics(docs), "quality-statistics")
    return scores(found, fit(found, labels, label, F.lit(True) if learns is None else learns))
