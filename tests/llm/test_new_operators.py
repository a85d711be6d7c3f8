"""Operators 11 to 13 against plain versions on small tables."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm import collocations, packing, ranked_search

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "one", "One two", "\n\n", "a\x85b c d", "Ünï 😀 x y z", "w " * 5000, "same text", "same text", "same text", "A\x00b 12a3 it's don't <|endoftext|>", "ß É ﬁ́ Σ"]


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]


def brute_search(docs, queries, k=10):
    """docs: (doc_id, text); queries: (item_id, text)."""
    words = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    asked = defaultdict(set)
    for item, text in queries:
        asked[item] |= set(terms(text))
    out = []
    for item, query in asked.items():
        found = []
        for i, c in words:
            m = 10 + 90 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in query if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def items(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())]))


def searched(docs, queries, k=10):
    return sorted((tuple(r) for r in ranked_search.ranked_documents(docs, queries, k).collect()), key=repr)


def test_nra_equals_reading_all():
    rng = np.random.default_rng(5)
    for case in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        lists = []
        for _ in range(rng.integers(1, 9)):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            parts = np.sort(rng.integers(0, 5, len(docs)))[::-1].astype(np.int64)
            lists.append((docs, parts))
        scores = ranked_search.scores_by_reading_all(lists, n)
        bound = int(rng.integers(1, 12))
        bar = max(bound, int(np.sort(scores)[-k]) if n >= k else 0)
        got, value = ranked_search.nra(lists, n, k, bound, first=1 + case % 4)
        want = np.flatnonzero(scores >= bar)
        assert sorted(got.tolist()) == want.tolist() and (scores[got] == value).all()


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search_equals_brute_force(spark, documents, monkeypatch, small):
    if small:  # many shards, blocks of queries, parts of shards and rounds of reading
        for name, value in (("SHARD_BYTES", 300), ("BLOCK", 7), ("STATE", 40), ("FIRST", 1), ("GROUPS", 2)):
            monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choices(["a", "b", "c", "dd", "Ee", "ff", "42", "ü"], [60, 30, 9, 5, 3, 2, 1, 1], k=rng.randint(0, 30))) for _ in range(150)), "rare " * 3, "b " * 3000]
    rows = [(i % 140, t) for i, t in enumerate(texts)] + [(None, "dd ff"), (None, "rare")]
    queries = [(1, "a b"), (2, "dd FF ee rare"), (2, "c"), (3, None), (4, "none at all"), (5, ""), (None, "rare, a"), (6, "same Text!"), (7, "a b c dd ee ff 42 ü one two same w")]
    asked = items(spark, [(i, t, "x") for i, t in queries])
    assert searched(documents(rows).repartition(3), asked, 10) == brute_search(rows, queries)
    assert searched(documents(rows), asked, 3) == brute_search(rows, queries, 3)


def test_ranked_search_of_empty_tables(spark, documents):
    assert searched(documents([]), items(spark, [(1, "a", "")])) == []
    assert searched(documents(["a"]), items(spark, [])) == []
    assert searched(documents([None, ""]), items(spark, [(1, "a", "")])) == []
    assert searched(documents(["a", "b"]), items(spark, [(1, "a", "")])) == brute_search([(0, "a"), (1, "b")], [(1, "a")])


# packing


def ids_of(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_packed(rows, got, capacity=4096):
    """Every id in exactly one piece, sequences gapless and not over capacity; returns the padding's share."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = defaultdict(Counter)  # by id: the documents' ids, as rows can share an id
    for i, t in rows:
        want[i][tuple(ids_of(t, tokenizer))] += 1
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(want)
    for i, texts in want.items():
        left = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i])
        for ids, n in texts.items():
            starts, at = sorted({r["start"]: r["length"] for r in by_doc[i] if r["doc_tokens"] == len(ids)}.items()), 0
            for start, length in starts:
                assert start == at
                crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                assert left[start, length, crc, len(ids)] >= n
                left[start, length, crc, len(ids)] -= n
                at += length
            assert at == len(ids)
        assert not +left
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
    padding = total = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, total + padding)


def test_cuts_cover_the_length():
    for capacity in (1, 7, 64, 4096):
        for length in [*range(0, 300), 4095, 4096, 4097, 12288, 100_001]:
            pieces = packing.cuts(length, capacity)
            assert sum(pieces) == length and all(0 < p <= capacity for p in pieces)
            assert all(p * (capacity // p) >= capacity * (1 - packing.SLACK) - capacity // p for p in pieces)


def test_packed_documents_hold_every_id_once(documents):
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta,", "gamma's", "élan", "x1y22", "漢字", "--", "don't", "é"]
    rows = [*enumerate(ODD), *((100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 700)))) for i in range(200)), (500, "long " * 9000), (3, "one"), (None, "a b")]
    got = packing.packed(documents(rows).repartition(4), TOKENIZER).collect()
    assert check_packed(rows, got) < 0.05
    small = packing.packed(documents(rows).repartition(3), TOKENIZER, capacity=64).collect()
    check_packed(rows, small, 64)


def test_packing_of_few_documents(documents):
    assert packing.packed(documents([]), TOKENIZER).collect() == []
    for rows in ([(1, None)], [(1, ""), (2, "")], [(1, "x"), (2, "y " * 5000)]):
        check_packed(rows, packing.packed(documents(rows), TOKENIZER).collect())


def test_encoder_equals_the_tokenizer_on_odd_words(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    encoder = packing.Encoder(TOKENIZER)
    texts = [t or "" for t in ODD] + ["".join(map(chr, range(1, 700))), "it's 'S 'll we'LL've 'x ''s 1's 12 3a a'sb 'REad x'", *(f"a{chr(i)}b'{chr(i)}S {chr(i)} x{chr(i)}'t" for i in [*range(1, 900), 0x1E9E, 0x2028, 0x3000, 0x1F600])]
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        ids, first = encoder.encoded(part)
        for k, t in enumerate(part):
            assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_no_other_character_has_the_parting_id():
    with open(TOKENIZER) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # byte 0 is written as this letter; only the parting word is that letter alone with the end of a word
    assert vocabulary["Ā</w>"] == packing.Encoder(TOKENIZER)._ids(packing.PART)[0]


# collocations


def brute_collocations(rows, least=10, share=50, most=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if any(len(q) > len(p) and lang == other and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f >= share * a for (other, q), f in found.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(all_)[:most], 1))


def table(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType())])
    return spark.createDataFrame([(i % 50, t, lang, "x") for i, (t, lang) in enumerate(rows)], schema)


@pytest.mark.parametrize(("shards", "small"), [(4, False), (2, True), (1, False)])
def test_collocations_equal_brute_force(spark, monkeypatch, shards, small):
    if small:  # many blocks that cut texts, ranges, and flushes within a task
        for name, value in (("BLOCK", 64), ("PER_RANGE", 100), ("FLUSH", 50)):
            monkeypatch.setattr(collocations, name, value)
    rng = random.Random(shards)
    vocabulary = ["new", "York", "city", "of", "THE", "ü", "big.", "apple,", "x!", "é", "漢", "rare"]
    rows = [(t, "en") for t in ODD] + [(" ".join(rng.choices(vocabulary, [30, 25, 20, 30, 30, 5, 5, 5, 2, 3, 4, 1], k=rng.randint(0, 60))), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(120)]
    rows += [("san francisco bay\tarea", "fr")] * 12 + [("same same same same", "de")] * 6 + [("tie a\nb tie", "es")] * 10
    df = table(spark, rows).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, shards=shards).collect())
    assert got == brute_collocations(rows) and len(got) > 20
    few = sorted(tuple(r) for r in collocations.collocations(df, least=3, most=4, share=80, shards=shards).collect())
    assert few == brute_collocations(rows, 3, 80, 4)


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, [(None, "en"), ("", None), (" .", "en")])).collect() == []
    assert collocations.collocations(table(spark, [("a b", "en")] * 9)).collect() == []


def test_scores_are_exact_past_64_bits():
    a, left, right = (np.array([x], np.int64) for x in (3_000_000_019, 3_000_000_037, 3_000_000_077))
    score, l_, r_ = collocations.least_score(a, [(left, right), (right, left)])
    assert int(score[0]) == 10**6 * 3_000_000_019**2 // (3_000_000_037 * 3_000_000_077)
    assert (int(l_[0]), int(r_[0])) == (3_000_000_037, 3_000_000_077)
