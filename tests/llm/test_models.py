import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import kneser_ney, language_id, pii, quality, toxicity
from chorus.llm.common import fold

ODD = ["", None, " .,", "a", "The cat the cat", "É è ñ", "x" * 3000, "\n\r", "the cat"]


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(-3, 50).select(F.col("id").alias("doc_id"), fold(7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 7 for r in rows)


# word model


def brute_scores(rows, learns):
    tok = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    train = [x for i, x in tok if learns(i)]
    count = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip(["<s>"] + x, x, strict=False))
    total, v = sum(count.values()), len(count)

    def discounts(c):
        n = [max(1, sum(1 for x in c.values() if x == k)) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0, *(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))]

    before, follow, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), x in pairs.items():
        follow[u] += x
        kinds[u][min(x, 3)] += 1
    d, low, n_pairs = discounts(pairs), discounts(before), sum(before.values())
    floor = sum(low[min(x, 3)] for x in before.values()) / n_pairs / (v + 1) if n_pairs else 1.0

    def p(u, w):
        one = floor + ((before[w] - low[min(before[w], 3)]) / n_pairs if before[w] else 0)
        if not follow[u]:
            return one
        x = pairs[(u, w)]
        return (x - d[min(x, 3)] + sum(a * b for a, b in zip(d, kinds[u], strict=True)) * one) / follow[u]

    out = {}
    for i, x in tok:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in x)
        out[i] = (len(x), sum(count[w] > 0 for w in x), total, base, sum(math.log10(p(u, w)) for u, w in zip(["<s>"] + x, x, strict=False)))
    return out


@pytest.mark.parametrize("small_shards", [False, True])
def test_scores(documents, monkeypatch, small_shards):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["the", "cat", "sat", f"w{rng.randrange(30)}", f"r{rng.random()}"]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["tick tock " * 200] * 3
    if small_shards:  # frequent words' pairs lie in several shards
        monkeypatch.setattr(kneser_ney, "PER_SHARD", 40)
    rows = list(enumerate(texts))
    got = kneser_ney.language_model_scores(documents(rows), F.col("doc_id") % 5 != 0).collect()
    want = brute_scores(rows, lambda i: i % 5 != 0)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:4] == want[r["doc_id"]][:3]
        assert tuple(r)[4:] == pytest.approx(want[r["doc_id"]][3:], rel=1e-9)


def brute_scores_of_order_3(rows, learns):
    tok = [(i, ["<s>"] + (t or "").encode().lower().split() + [None]) for i, t in rows]
    train = [x for i, x in tok if learns(i)]
    raw = Counter(p for x in train for p in zip(x, x[1:], strict=False))
    triples = Counter(p for x in train for p in zip(x, x[1:], x[2:], strict=False))
    pairs = Counter((v, w) for _, v, w in triples) + Counter({p: c for p, c in raw.items() if p[0] == "<s>"})
    before = Counter(w for _, w in raw)

    def discounts(c):
        n = [max(1, sum(1 for x in c.values() if x == k)) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0, *(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))]

    def level(counts):
        d, total, rest = discounts(counts), Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            rest[g[:-1]] += d[min(c, 3)]
        return lambda g, p: (counts[g] - d[min(counts[g], 3)] + rest[g[:-1]] * p) / total[g[:-1]] if total[g[:-1]] else p

    one, two, three = level(Counter({(w,): c for w, c in before.items()})), level(pairs), level(triples)

    def p(x, i):
        out = two((x[i - 1], x[i]), one((x[i],), 1 / (len(before) + 1)))
        return three((x[i - 2], x[i - 1], x[i]), out) if i > 1 else out

    return {i: sum(math.log10(p(x, k)) for k in range(1, len(x))) for i, x in tok}


@pytest.mark.parametrize("small_shards", [False, True])
def test_scores_of_order_3(documents, monkeypatch, small_shards):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["the", "cat", "sat", f"w{rng.randrange(30)}", f"r{rng.random()}"]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["tick tock " * 200] * 3
    if small_shards:  # frequent pairs' triples lie in several shards
        monkeypatch.setattr(kneser_ney, "PER_SHARD", 40)
    rows = list(enumerate(texts))
    got = kneser_ney.language_model_scores(documents(rows), F.col("doc_id") % 5 != 0, order=3).collect()
    want = brute_scores_of_order_3(rows, lambda i: i % 5 != 0)
    assert len(got) == len(rows)
    assert [r["score"] for r in got] == pytest.approx([want[r["doc_id"]] for r in got], rel=1e-9)


def test_a_worker_keeps_few_files_open(documents, monkeypatch):
    """Many shards, and as many words as ranges: reading all of them opens a bounded number of files."""
    monkeypatch.setattr(kneser_ney, "PER_SHARD", 5)
    rng = random.Random(6)
    docs = documents([" ".join(f"w{rng.randrange(400)}" for _ in range(50)) for _ in range(60)])
    model = kneser_ney.train(docs, 3)
    before = len(os.listdir("/proc/self/fd"))
    reader = kneser_ney.Reader(model)
    assert len(reader.shards) > 300 and len(reader.triples) > 100
    n = model.n
    word = np.arange(n)
    for previous in range(0, n, 7):
        found = reader.pair(np.full(n, previous), word)
        seen = found.place[found.place >= 0]
        reader.last_word(np.sort(seen))
        if len(seen):
            reader.triple(np.repeat(np.sort(seen)[:50], 3), np.tile([0, n // 2, n - 1], len(seen[:50])))
    reader.unigram(word)
    assert len(os.listdir("/proc/self/fd")) - before <= 256


def test_scores_without_training_texts(documents):
    got = kneser_ney.language_model_scores(documents(["a b"]), F.lit(False)).collect()
    assert (got[0]["n_known"], got[0]["train_tokens"]) == (0, 0)
    assert kneser_ney.language_model_scores(documents([])).count() == 0


# languages


def test_language(spark, documents):
    rng = random.Random(4)
    words = {"aa": ["bala", "kala", "mala", "sola"], "bb": ["trin", "prin", "strin", "krin"], "cc": ["ñoño", "áño", "niño"]}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(30))) for lang, w in words.items() for _ in range(20)]
    docs = None
    for lang in words:
        part = documents([(i, t) for i, (x, t) in enumerate(rows) if x == lang], lang)
        docs = part if docs is None else docs.union(part)
    docs = docs.union(documents([(100 + i, t) for i, t in enumerate(["", None, " .,12", "x" * 3000, "BALA KALA", "kala"])], None)).withColumn("evidence", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, F.col("doc_id") % 4 != 0).collect()}
    assert all(got[i]["lang_pred"] == lang for i, (lang, _) in enumerate(rows))
    assert [got[100 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[104]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = {r["doc_id"]: r for r in language_id.identify(docs, F.lit(False)).collect()}
    assert {r["lang_pred"] for r in nothing.values()} == {"und"}
    strict = language_id.identify(docs, reject_below=1.1).collect()
    assert {r["lang_pred"] for r in strict} == {"und"}
    assert language_id.identify(documents([])).count() == 0


def test_character_probabilities_sum_to_one(documents, monkeypatch):
    model = language_id.train(documents(["abab baab abba", "ab ba"] * 3))
    reader = language_id._Reader(model["folder"], model["files"]["en"])
    seen = [int(k) for k in reader.orders[0][0]]
    for context in ([97, 98, 97], [32, 32, 32], [122, 122, 97]):
        keys = np.sort(np.array([sum(c << (16 * (3 - i)) for i, c in enumerate([*context, w])) for w in [*seen, 500]], np.uint64))
        assert np.exp(reader.log_p(keys)).sum() == pytest.approx(1, rel=1e-5)


# classifiers


def auc(score, label):
    order = np.argsort(np.argsort(score))
    y = np.asarray(label) == 1
    return (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def test_quality(spark, documents):
    rng = random.Random(5)
    good = [" ".join(rng.choice("the cat sat on some green hill with many old trees".split()) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(20, 80))) for _ in range(150)]
    bad = [" ".join(["BUY!!"] * rng.randrange(10, 60)) for _ in range(75)] + [" ".join(f"{rng.randrange(99)}$$$" for _ in range(40)) for _ in range(75)]
    rows = list(enumerate(good + bad))
    docs = documents(rows + [(900 + i, t) for i, t in enumerate(ODD)]).withColumn("s0", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 150)) for i, _ in rows] + [(0, 0), (901, None), (5000, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels, learns=F.col("doc_id") % 4 != 2).collect()}
    held = [i for i, _ in rows if i % 4 == 2]
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    assert auc([got[i] for i in held], [i < 150 for i in held]) > 0.98
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.quality_scores(documents([]), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.1, 0.5, 0.3, 0.2, 0.9]))
    assert x.tolist() == [0, 0, 1, 3, 4, 4] and y == pytest.approx([0.1, 0.1, 1 / 3, 1 / 3, 0.9, 0.9])


def test_toxicity(spark, documents):
    rng = random.Random(6)
    plain = [f"word{k}" for k in range(60)]
    rows, label = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        label.append(int(i % 4 == 0))
        if label[-1]:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grubbel", "snarkoid"]))
        rows.append((i, " ".join(w)))
    copies = [(1000 + i, rows[0][1]) for i in range(60)]  # a toxic text that many copies share
    docs = documents(rows + copies + [(900 + i, t) for i, t in enumerate(ODD)]).withColumn("pattern", F.lit("clash"))
    labels = spark.createDataFrame([*((i, y) for (i, _), y in zip(rows, label, strict=True)), *((i, 1) for i, _ in copies), (901, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels, learns=F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert len(got) == len(rows) + len(copies) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == label[i] for i in held]) > 0.97
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(documents([]), labels).count() == 0


def hash_of(word):
    return toxicity.tokens.words(*toxicity.tokens.string_bytes(toxicity.pa.array([word])), toxicity.tokens.NOT_ALNUM)[0][0]


def test_lexicon_keeps_rare_terms_among_many_common_ones(documents):
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxy") for _ in range(9)) for _ in range(4500)]
    rows = []
    for i in range(80):  # over 20,000 neutral words and heads with more different words before them
        w = [rng.choice(plain) for _ in range(3000)]
        if i < 20:
            w += [plain[i % 4], "zug"]
        rows.append((i, " ".join(w)))
    train = documents(rows).withColumn("label", (F.col("doc_id") < 40).cast("int"))
    terms, _ = toxicity.learn_lexicon(train, {0: 40, 1: 40})
    assert hash_of("zug") in terms


def test_lexicon_shares_are_of_texts(documents):
    rows = [(i, f"{'abc'[i % 3]} zug") for i in range(1500)] + [(i, "a b c") for i in range(1500, 3000)]
    train = documents(rows).withColumn("label", (F.col("doc_id") < 1500).cast("int"))
    terms, tier = toxicity.learn_lexicon(train, {0: 1500, 1: 1500})
    assert terms.tolist() == [hash_of("zug")] and tier.tolist() == [0]


def test_label_model_finds_the_better_voter():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.6)] + [np.zeros(4000, bool)] * (toxicity.VOTERS - 4), axis=1).astype(float)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = toxicity.label_model(patterns, np.full(len(patterns), -1), n.astype(float))
    assert np.mean((post[at.ravel()] > 0.5) == truth) > 0.93


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    for _ in range(20000):
        t = "".join(rng.choice("a.b@c_1 2-+9.@.é") for _ in range(rng.randrange(30)))
        want = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if k == "email" or pii._passes(k, m[0])]
        assert pii.base_spans(t) == want


DISGUISED = [
    ("mail john.doe [at] mail dot com now", "email", "john.doe [at] mail dot com"), ("x john(at)mail(dot)com", "email", "john(at)mail(dot)com"), ("é jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("us​er@mail.com", "email", "us​er@mail.com"), ("call plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"),
    ("no four zero four one 8949 7460 8795 ok", "card", "four zero four one 8949 7460 8795"), ("ip one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one"),
    ("ip 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"), ("１９２.168.1.1", "ip", "１９２.168.1.1"),
]


def test_disguises_map_back_to_the_source(documents):
    rows = list(enumerate(t for t, _, _ in DISGUISED))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(rows)).collect()}
    for i, (text, kind, span) in enumerate(DISGUISED):
        assert f"{kind}:{text.index(span)}:{text.index(span) + len(span)}" in got[i].split(",")


def test_the_gate_lets_through_what_the_patterns_find():
    rng = random.Random(9)
    gap = lambda: rng.choice(["", " ", "  ", "\t"])
    texts = ["eight dot eight dot eight dot eight", "john@ example.com", "john@example [ . ] com", "plus VIER FÜNF FÜNF ZÉRO vier vier vier vier vier vier", "plus 15551234567 plus eight", "×four dot eight dot eight dot×eight dot eight", "john at mail-.com", "john(arobaſe)mail.com"]
    for _ in range(4000):
        names = [rng.choice([k, k.upper(), k.title()]) for k in rng.choices(sorted(pii._DIGITS), k=12)]
        at = rng.choice([f"{gap()}@{gap()}", f"{gap()}[{gap()}@{gap()}]{gap()}", " at ", " AT ", "_AT_", "(ät)", "(ÄT)", " Arroba "])
        stop = rng.choice([".", f"{gap()}[{gap()}.{gap()}]{gap()}", f"{gap()}<{gap()}dot{gap()}>", " Punkt ", "_DOT_", "-DOT-"])
        texts.append(rng.choice([f"john{at}mail{stop}com", f"john{stop}doe{at}mail{stop}com", f" {rng.choice([' ', ', ', ' - '])} ".join(names), f" {rng.choice(['dot', 'Point', 'PUNTO'])} ".join(names[:4]), stop.join("8888"), "plus " + " ".join(names)]))
    for t in texts:
        plain, hidden = pii._flags(pii.pa.array([t]))
        base, spans = pii.find_spans(t)
        assert hidden[0] or spans == base, t
        assert plain[0] or not base, t
    plain, hidden = pii._flags(pii.pa.array(texts))
    assert all(h or pii.find_spans(t)[0] == pii.find_spans(t)[1] for t, h in zip(texts, hidden, strict=True))


def test_clean_and_odd_texts_have_no_spans(documents):
    clean = [*ODD, "We met at home. Then we left.", "one two three", "meet at the dot of noon, e.g. here", "version 1.2.3"]
    assert all(r["spans"] == "" and r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0 for r in pii.personal_data(documents(clean)).collect())
    both = pii.personal_data(documents([(1, "a@b.co c@d.eu +1 (988) 555-2485; 4041894974608795; 42.144.35.254; 999.1.1.1")] * 2)).collect()
    assert [tuple(r)[1:5] for r in both] == [(2, 1, 1, 1)] * 2
    assert pii.personal_data(documents([])).count() == 0
