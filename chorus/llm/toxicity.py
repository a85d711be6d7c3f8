"""Toxicity by weak supervision (operator 9).

1. Lexicon: every word and word beginning (of 4 to 8 bytes) that a share of the
   toxic learning texts holds; all of them are stored by range of hash, and the
   clean texts that hold them and the *different words before them* are counted
   in a second pass.  Terms with few different words before them (a passage that
   many copies share) or that clean texts hold too are left out; of the others the
   strongest ``LEXICON`` are kept (a documented bound of the fit; all learning
   texts and terms are counted).
2. Voters: the lexicon in tiers by support and purity, its terms behind digits and
   signs that stand for letters, and patterns (shouting, runs of exclamation
   marks, a second person).  A voter votes toxic or abstains.
3. Label model: the voters' accuracies under the unknown truth, by expectation
   maximisation over the counts of the vote patterns (a few thousand at most), learning
   labels anchored; pairs that agree beyond what the truth explains share their weight.
4. A linear classifier on the votes, the numbers of hits and the texts' shape,
   fitted by Newton steps whose sums Spark forms, on the posterior labels.  It
   learns on a third of the texts from a lexicon of the others; the scores then
   use the lexicon of all learning texts.

Null texts count as empty and are scored.  Several labels of one document: the
largest counts.  Without both kinds of labels, or without learning texts, the score is 0 everywhere.  Rows
are independent, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import get_array, merge_counts, new_folder, pack, put_array, slice_rows, stored, texts, unpack

LEXICON = 2000
LEAST_CONTEXTS = 3
LEAST_SHARE = 0.004
LEAST_RATIO = 20.0
HEADS = (4, 5, 6, 7, 8)
SHARDS = 64
FLUSH = 1_500_000
STEPS = 12
RIDGE = 1.0
_KINDS = 1 + len(HEADS)
#: Shares of the toxic learning texts that part the lexicon's tiers, from strong to weak;
#: each tier is split by whether any clean text holds the term.
_SUPPORT = (0.1, 0.03, 0.01)
_HITS = 2 * (len(_SUPPORT) + 1)
VOTERS = _HITS + 4

# Signs that stand for letters, and words that address someone.
_SIGNS = tokens.LOWER.copy()
for _from, _to in zip(b"013457@$", b"oieastas", strict=True):
    _SIGNS[_from] = _to
_SIGN_STOPS = tokens.NOT_ALNUM.copy()
_SIGN_STOPS[list(b"@$")] = False
_SECOND_PERSON = ("you", "your", "yours", "yourself", "ur", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "ta", "vous", "votre", "ti", "tus", "usted", "vosotros")


def _terms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, of, first, previous): per word a column of its hash and its heads' (0 for none),
    the text it belongs to, the texts' ranges, and the word before it."""
    data, offsets = tokens.string_bytes(column)
    heads = [(n, np.empty(0, np.uint64)) for n in HEADS]
    h, _, _, first = tokens.words(data, offsets, tokens.NOT_ALNUM, heads=heads)
    of = tokens.lengths_to_index(np.diff(first))
    previous = np.r_[np.uint64(0), h[:-1]] if len(h) else h
    previous[first[:-1][np.diff(first) > 0]] = 0
    return np.stack([h, *(x for _, x in heads)], axis=1) if len(h) else np.empty((0, _KINDS), np.uint64), of, first, previous


def _by_shard(keys: np.ndarray, cut: np.ndarray, *columns: np.ndarray) -> dict[int, bytes]:
    """Sorted keys with columns, packed by shard; cut: where the shards' keys begin and the last one's end."""
    return {int(s): pack(keys[cut[s] : cut[s + 1]], *(c[cut[s] : cut[s + 1]] for c in columns)) for s in np.flatnonzero(np.diff(cut))}


def _text_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each term, packed by shard of the term."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        k, c = merge_counts(keys, counts)
        found = _by_shard(k, np.searchsorted(k >> np.uint64(58), np.arange(SHARDS + 1, dtype=np.uint64)), c)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.binary())], names=["shard", "entries"])

    for b in (part for whole in batches for part in slice_rows(whole)):
        terms, of, _, _ = _terms(b.column("text"))
        has = terms.ravel() != 0
        flat, text = terms.ravel()[has], np.repeat(of, _KINDS)[has]
        order = np.argsort(flat, kind="stable")  # texts ascend within a term
        flat, text = flat[order], text[order]
        once = np.r_[True, (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])][: len(flat)]
        k, c = np.unique(flat[once], return_counts=True)
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > FLUSH:
            yield flush()
            keys, counts, held = [], [], 0
    if held:
        yield flush()


def _frequent(folder: str, least: float):
    """Store a shard's terms that at least so many texts hold, with the numbers of those texts."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in t.column("entries")]
        k, c = merge_counts([p[0] for p in parts], [p[1] for p in parts])
        keep = c >= least
        return pa.table({"shard": t.column("shard")[:1], "n": [int(keep.sum())], "terms": [put_array(folder, "terms", k[keep])], "texts": [put_array(folder, "texts", c[keep])]})

    return run


def _evidence(folder: str, files: list[dict]):
    """For the stored terms, by place among all of them and packed by shard: the distinct
    words before them in toxic texts, and the number of clean texts that hold them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored_terms = np.concatenate([get_array(folder, f["terms"], np.uint64) for f in files if f["n"]])
        base = np.r_[0, np.cumsum([f["n"] for f in files])]
        clean = np.zeros(len(stored_terms), np.int64)
        before: list[np.ndarray] = []
        for b in (part for whole in batches for part in slice_rows(whole)):
            terms, of, _, previous = _terms(b.column("text"))
            toxic = b.column("label").to_numpy() == 1
            at = np.minimum(np.searchsorted(stored_terms, terms.ravel()), len(stored_terms) - 1)
            hit = np.flatnonzero(stored_terms[at] == terms.ravel())
            at, word = at[hit], hit // _KINDS
            mine = toxic[of[word]]
            pairs = np.unique(of[word[~mine]] * len(stored_terms) + at[~mine])
            clean += np.bincount(pairs % len(stored_terms), minlength=len(stored_terms))
            before.append(_distinct(at[mine], previous[word[mine]]))
        if not before:
            return
        pairs = _distinct(*np.concatenate(before).T)
        contexts = _by_shard(pairs[:, 0], np.searchsorted(pairs[:, 0], base.astype(np.uint64)), pairs[:, 1].view(np.int64))
        some = np.flatnonzero(clean)
        texts_of = _by_shard(some, np.searchsorted(some, base), clean[some])
        shards = sorted({*contexts, *texts_of})
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([contexts.get(s) for s in shards], pa.binary()), pa.array([texts_of.get(s) for s in shards], pa.binary())], names=["shard", "contexts", "clean"])

    return run


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted distinct rows (a, b)."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return np.stack([a[once], b[once]], axis=1)


def _rated(folder: str, files: list[dict], labelled: dict[int, int]):
    """A shard's terms that the toxic texts hold far more often than the clean ones."""

    def run(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        base = sum(f["n"] for f in files[:s])
        terms, toxic = get_array(folder, files[s]["terms"], np.uint64), get_array(folder, files[s]["texts"], np.int64)
        contexts, clean = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        parts = [unpack(x.as_py()) for x in t.column("contexts") if x.is_valid]
        if parts:
            pairs = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].view(np.uint64) for p in parts]))
            contexts = np.bincount(pairs[:, 0].astype(np.int64) - base, minlength=len(terms))
        for x in t.column("clean"):
            if x.is_valid:
                at, n = unpack(x.as_py())
                clean[at.astype(np.int64) - base] += n
        ratio = ((toxic + 0.5) / (labelled[1] + 1)) / ((clean + 0.5) / (labelled[0] + 1))
        keep = (contexts >= LEAST_CONTEXTS) & (ratio >= LEAST_RATIO)
        tier = 2 * sum((toxic < share * labelled[1]).astype(int) for share in _SUPPORT) + (clean > 0)
        value = np.minimum(contexts, toxic) * np.log(ratio)
        return pa.table({"term": pa.array(terms[keep].view(np.int64)), "tier": pa.array(tier[keep].astype(np.int32)), "value": pa.array(value[keep])})

    return run


def learn_lexicon(train: DataFrame, labelled: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, tier): sorted term hashes.  train: (doc_id, text, label)."""
    folder = new_folder(train.sparkSession, "toxicity-lexicon")
    least = max(LEAST_CONTEXTS, LEAST_SHARE * labelled[1])
    found = train.filter("label = 1").select("text").mapInArrow(_text_counts, "shard int, entries binary").groupBy("shard").applyInArrow(_frequent(folder, least), "shard int, n long, terms string, texts string").collect()
    by_shard = {r["shard"]: r.asDict() for r in found if r["n"]}
    if not by_shard:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    files = [by_shard.get(s, {"n": 0}) for s in range(SHARDS)]
    evidence = train.filter("label is not null").select("text", "label").mapInArrow(_evidence(folder, files), "shard int, contexts binary, clean binary")
    rated = evidence.groupBy("shard").applyInArrow(_rated(folder, files, labelled), "term long, tier int, value double").orderBy(F.desc("value"), F.desc("term")).limit(LEXICON).collect()
    terms = np.array([r["term"] for r in rated], np.int64).view(np.uint64)
    tier = np.array([r["tier"] for r in rated], np.int64)
    order = np.argsort(terms)
    return terms[order], tier[order]


_FEATURES = VOTERS + 2 * _HITS + 4


def _vote(column, terms: np.ndarray, tier: np.ndarray) -> np.ndarray:
    """A row per text: votes, hits by tier (log count and share), and shape."""
    found, of, first, _ = _terms(column)
    n = len(first) - 1
    words = np.maximum(np.diff(first), 1)
    hits = np.zeros((n, _HITS))
    if len(terms) and len(found):
        at = np.minimum(np.searchsorted(terms, found.ravel()), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == found.ravel())
        hits = np.bincount(np.repeat(of, _KINDS)[hit] * _HITS + tier[at[hit]], minlength=n * _HITS).reshape(n, _HITS).astype(float)
    data, offsets = tokens.string_bytes(column)
    low = tokens.words(data, offsets, _SIGN_STOPS, table=_SIGNS)
    spelled = np.bincount(tokens.lengths_to_index(np.diff(low[3]))[np.isin(low[0], terms)], minlength=n) - np.bincount(of[np.isin(found[:, 0], terms)], minlength=n) if len(terms) else np.zeros(n)
    row = tokens.lengths_to_index(np.diff(offsets))
    upper = np.bincount(row, (data >= 65) & (data <= 90), minlength=n)
    letters = np.maximum(1, upper + np.bincount(row, (data >= 97) & (data <= 122), minlength=n))
    loud = np.bincount(row, data == 33, minlength=n)
    person = tokens.words(*tokens.string_bytes(pa.array(sorted(_SECOND_PERSON))), tokens.NOT_ALNUM)[0]
    addressed = np.bincount(of, np.isin(found[:, 0], person), minlength=n) if len(found) else np.zeros(n)
    votes = np.stack([*(hits[:, k] > 0 for k in range(_HITS)), spelled > 0, upper / letters > 0.5, loud / words > 0.2, addressed > 0], axis=1)
    return np.hstack([votes, np.log1p(hits), hits / words[:, None], np.stack([upper / letters, loud / words, addressed / words, np.log1p(words)], axis=1)]).astype(float)


def _votes(terms: np.ndarray, tier: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slice_rows(whole)):
            x = _vote(b.column("text"), terms, tier)
            pattern = x[:, :VOTERS].astype(np.int64) @ (1 << np.arange(VOTERS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pattern), pa.array(list(x))], names=["doc_id", "pattern", "x"])

    return run


def label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of toxic for each row of vote patterns (0/1 by voter); labels: 0, 1, or -1 for none."""
    anchored = np.where(labels == 1, 0.98, 0.02)
    known = labels >= 0
    post = np.where(known, anchored, 0.5 * patterns[:, :_HITS].any(axis=1) + 0.02)
    weight = np.ones(patterns.shape[1])
    for step in range(30):
        prior = np.clip((counts * post).sum() / counts.sum(), 1e-4, 1 - 1e-4)
        rate = [(((counts * p) @ patterns) + 0.5) / ((counts * p).sum() + 1) for p in (1 - post, post)]
        if step % 5 == 4:  # agreement that the truth leaves unexplained, by pairs of voters
            residual = patterns - np.outer(post, rate[1]) - np.outer(1 - post, rate[0])
            cov = (residual * counts[:, None]).T @ residual / counts.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            weight = 1 / np.maximum(1, np.clip(cov / np.outer(sd, sd), 0, 1).sum(axis=1))
        odds = np.log(prior / (1 - prior)) + (patterns * np.log(rate[1] / rate[0]) + (1 - patterns) * np.log((1 - rate[1]) / (1 - rate[0]))) @ weight
        free = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        post = np.where(known, 0.9 * anchored + 0.1 * free, free)
    return post


def _newton_sums(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Per task: gradient and curvature of the logistic loss on posterior labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w), len(w) + 1))
        for b in batches:
            x = _standard(np.asarray(b.column("x").to_pylist(), float).reshape(-1, _FEATURES), mean, scale)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            total[:, :-1] += (x * (p * (1 - p))[:, None]).T @ x
            total[:, -1] += x.T @ (b.column("target").to_numpy() - p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    return run


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", learns: Column | None = None) -> DataFrame:
    """(doc_id, score) of every row of docs, learnt from the labelled rows that satisfy learns."""
    learns = F.lit(True) if learns is None else learns
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).filter(learns)
    known = stored(known, "toxicity-labels")

    def numbers(rows: DataFrame) -> dict[int, int]:
        return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    labelled = numbers(known)
    if not labelled.get(0) or not labelled.get(1):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    schema = "doc_id long, pattern long, x array<double>"
    # the classifier learns on a third of the texts how far to trust a lexicon that has not seen them
    third = F.pmod(F.hash(F.col("doc_id").cast("long")), F.lit(3)) == 0
    others = numbers(known.filter(~third))
    if min(others.get(0, 0), others.get(1, 0)) < 20:
        third, others = F.lit(True), labelled
        terms, tier = learn_lexicon(texts(docs).join(known, "doc_id"), labelled)
    else:
        terms, tier = learn_lexicon(texts(docs).join(known.filter(~third), "doc_id"), others)
    train = stored(texts(docs).filter(learns & third).mapInArrow(_votes(terms, tier), schema).join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1))), "toxicity-train")
    seen = train.groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern", "label").collect()
    if not seen:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    bits = np.array([[r["pattern"] >> k & 1 for k in range(VOTERS)] for r in seen], float)
    post = label_model(bits, np.array([r["label"] for r in seen]), np.array([r["n"] for r in seen], float))
    target = docs.sparkSession.createDataFrame([(r["pattern"], r["label"], float(p)) for r, p in zip(seen, post, strict=True)], "pattern long, label int, target double")
    fit = stored(train.join(F.broadcast(target), ["pattern", "label"]).select("x", "target"), "toxicity-fit")
    moments = fit.agg(*(F.avg(F.col("x")[i]) for i in range(_FEATURES)), *(F.stddev_pop(F.col("x")[i]) for i in range(_FEATURES))).first()
    mean, scale = np.array(moments[:_FEATURES], float), np.array(moments[_FEATURES:], float)
    scale = np.where(scale > 1e-9, scale, 1)
    w = np.zeros(_FEATURES + 1)
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        sums = np.zeros((len(w), len(w) + 1))
        for r in fit.mapInArrow(_newton_sums(w, mean, scale), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            sums.ravel()[r["cell"]] = r["value"]
        step = np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1] - penalty * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-3:
            break

    terms, tier = learn_lexicon(texts(docs).join(known, "doc_id"), labelled)
    rows = texts(docs).mapInArrow(_votes(terms, tier), schema)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _standard(np.asarray(b.column("x").to_pylist(), float).reshape(-1, _FEATURES), mean, scale)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")
