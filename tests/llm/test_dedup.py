import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import exact_dedup, line_dedup, ngram_jaccard, stages, tokens
from chorus.llm.common import pack, unpack

ODD = ["", None, " ", "one", "One two", "\n\n", "a\x85b c d", "Ünï 😀 x y z", "w " * 5000, "same text", "same text", "same text"]


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_pack_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    values = np.random.default_rng(2).integers(-5, 1 << 40, 1000)
    k, v = unpack(pack(keys, values))
    assert (k == keys).all() and (v == values).all()
    assert [len(x) for x in unpack(pack(keys[:0], values[:0]))] == [0, 0]


def test_words_match_plain_splitting(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "PIECE", 16)  # pieces end inside texts
    texts = ["Ab  cd\tE", "", None, "longwordthatislongerthanapiece x", "x" * 50, "\x0b\x0c\r\n ", "ab cd e"]
    data, offsets = tokens.string_bytes(pa.array(texts))
    h, start, end, first = tokens.words(data, offsets)
    for i, t in enumerate(texts):
        want = (t or "").encode().lower().split()
        got = [bytes(data[a:b]).lower() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
        assert got == want
    assert (h[first[0] : first[1]] == h[first[6] : first[7]]).all()


# exact duplicates


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 12, 3000).astype(np.uint64) << np.uint64(52) for _ in range(2))
    merged = exact_dedup.CountingQuotientFilter.build(a, 8).merge(exact_dedup.CountingQuotientFilter.build(b, 8))
    want, n = np.unique(np.concatenate([a, b]), return_counts=True)
    assert (merged.fingerprints() == want).all() and (merged.counts == n).all()
    parts = [exact_dedup.CountingQuotientFilter.part(x, 4) for _, x in merged.ranges(4)]
    assert (np.concatenate([p.fingerprints() for p in parts]) == want).all()
    assert (np.concatenate([p.counts for p in parts]) == n).all()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("rows", [list(enumerate(ODD)), [(1, "a"), (1, "a"), (2, "b"), (-3, "a")], []])
def test_exact_duplicates(documents, rows):
    got = sorted(tuple(r) for r in exact_dedup.exact_duplicates(documents(rows).withColumn("fp", F.lit("clash")).withColumn("text_sha256", F.lit(1))).collect())
    assert got == brute_exact(rows)


def test_equal_fingerprints_of_different_texts_are_told_apart(documents, monkeypatch):
    docs = documents(["a", "b", "a"])
    prints = exact_dedup.fingerprints(docs).withColumn("fp", F.lit(7).cast("long"))
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda _: prints)
    got = collected(exact_dedup.exact_duplicates(docs))
    assert [got[i]["keep_id"] for i in range(3)] == [2, 1, 2] and got[1]["group_size"] == 1


# lines


def brute_lines(rows, min_chars=10):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


LINES = [(5, "Shared line here\nown five\nshared LINE here "), (3, "\tshared line here\r\nshort\nSHORT"), (9, "short\n\nshared line here\nété été été été"), (11, "été été été été\nÉté été été été"), (12, None), (13, ""), (14, "twice in one doc\ntwice in one doc")]


def test_lines(documents):
    docs = documents(LINES).withColumn("hi", F.lit("x")).withColumn("kept_text", F.lit("y"))
    got = sorted((r["doc"]["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.without_repeated_lines(docs).collect())
    assert got == brute_lines(LINES)
    assert line_dedup.without_repeated_lines(documents([])).count() == 0


def test_without_broadcast_filters(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    got = sorted((r["doc"]["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.without_repeated_lines(documents(LINES)).collect())
    assert got == brute_lines(LINES)


def state(index):
    return sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.postings.collect())), sorted((r["doc_id"], r["hi"]) for r in line_dedup.drops(index).collect())


def test_insert_and_delete_are_reversible(spark, documents):
    first, second = documents(LINES[:3]), documents(LINES[3:] + [(1, "Shared line here\nnew one of them")])
    whole = line_dedup.build_index(documents(LINES + [(1, "Shared line here\nnew one of them")]), shards=4)
    start = line_dedup.build_index(first, shards=4)
    grown = line_dedup.insert(start, second)
    assert state(grown) == state(whole)
    assert state(line_dedup.insert(grown, second)) == state(whole)
    assert state(line_dedup.delete(grown, second.select("doc_id"))) == state(start)


def test_cuckoo_filter_keeps_and_removes():
    rng = np.random.default_rng(5)
    hi, lo = rng.integers(-(1 << 62), 1 << 62, (2, 2000))
    f = line_dedup.CuckooFilter(2000)
    f.insert(hi, lo)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(hi, lo).all()
    f.remove(hi[:1000], lo[:1000])
    assert f.contains(hi[1000:], lo[1000:]).all() and f.contains(hi[:1000], lo[:1000]).mean() < 0.05
    crowded = line_dedup.CuckooFilter(8)
    crowded.insert(hi[:200], lo[:200])
    assert crowded.stash and crowded.contains(hi[:200], lo[:200]).all()


# near copies


def brute_components(rows, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def family(rng, n, edits, words=80):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, edits + 1)):
            k = rng.randrange(len(w))
            if rng.random() < 0.6:
                w[k] = f"z{rng.randrange(3000)}"
            elif rng.random() < 0.5:
                del w[k]
            else:
                w.insert(k, f"y{rng.randrange(40)}")
        out.append(" ".join(w))
    return out


def check_components(documents, texts, words=4, percent=85):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    got = collected(ngram_jaccard.linked_components(documents(rows).withColumn("rep", F.lit(1)).withColumn("label", F.lit(1)), words, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, words, percent)


def test_odd_texts(documents):
    check_components(documents, ODD)
    assert ngram_jaccard.linked_components(documents([])).count() == 0


def test_families_in_small_buckets(documents):
    rng = random.Random(7)
    check_components(documents, [t for _ in range(12) for t in family(rng, 6, 5, rng.randrange(6, 120))])


@pytest.mark.parametrize("seed", [1])
def test_families_in_large_buckets(documents, monkeypatch, seed):
    monkeypatch.setattr(ngram_jaccard, "SMALL", 8)
    rng = random.Random(seed)
    common = " ".join(f"p{i}" for i in range(40))
    texts = family(rng, 40, 4) + [f"{t} {common}" for t in family(rng, 20, 4, 40)] + [f"{common} q{i} r{i} s{i}" for i in range(12)]
    rng.shuffle(texts)
    check_components(documents, texts)


def test_five_words_and_eighty_percent(documents):
    rng = random.Random(11)
    check_components(documents, [t for _ in range(5) for t in family(rng, 12, 6)], 5, 80)


def test_rows_that_share_an_id_are_compared_each(documents):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, b + " more"), (3, "x y z w v"), (3, None)]
    got = sorted(tuple(r) for r in ngram_jaccard.linked_components(documents(rows)).collect())
    assert got == [(1, 37, 1), (1, 57, 1), (2, 38, 1), (3, 0, 3), (3, 2, 3)]


def test_overlapping_clusters_need_few_rounds(documents, monkeypatch):
    """Variants of one text that mostly do not link with each other: groups are small enough
    to be compared after a few doublings, and the links are those of brute force."""
    monkeypatch.setattr(ngram_jaccard, "SMALL", 3)
    monkeypatch.setattr(ngram_jaccard, "FEW", 4)
    rounds, refined = [], ngram_jaccard._refined
    monkeypatch.setattr(ngram_jaccard, "_refined", lambda *a: rounds.append(a[2]) or refined(*a))
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.06 else f"n{rng.randrange(9)}" for w in base) for _ in range(90)]
    rows = list(enumerate(texts))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for t in texts]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.linked_components(documents(rows)).collect()}
    assert got == dict(enumerate(label)) and len(rounds) <= 6


def sharing(n, seed=7, words=300, pool=400):
    """Texts of sentences from one pool: many share some shingles, few link."""
    rng = np.random.default_rng(seed)
    sentences = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 12)) for _ in range(pool)]
    return [" ".join(sentences[i] for i in rng.integers(0, pool, words // 12)) for _ in range(n)]


def test_chance_agreements_are_not_compared(documents, monkeypatch):
    """Pairs that agree in a piece by chance grow with the square of the documents: few of them may go on."""
    met = []
    compared = ngram_jaccard._Join.compared

    def counted(self, pairs, name, rooted=False):
        met.append(pairs.count())
        return compared(self, pairs, name, rooted)

    monkeypatch.setattr(ngram_jaccard._Join, "compared", counted)
    texts = sharing(600)
    texts += [t + " one more ending" for t in texts[:5]]
    check_components(documents, texts, 5, 80)
    assert sum(met) < len(texts)


def test_stages_move_no_texts_for_few_dropped_ids(spark, documents):
    """Rows that share a doc_id stay when one of them is kept; a row without doc_id goes."""
    docs = documents([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")])
    judged = spark.createDataFrame([(1, True), (1, False), (2, False), (3, True)], "doc_id long, ok boolean")
    out = stages._keeping(docs, judged, F.col("ok"), "test-gone")
    assert sorted(r["text"] for r in out.collect()) == ["a", "b", "d"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
