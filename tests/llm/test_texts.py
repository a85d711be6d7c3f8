import base64
import random
import re
import struct
import tracemalloc
from hashlib import sha256

import public_tokenizers
import pytest
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F

from chorus.llm import bpe, decontaminate, stages

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "don't  stop\n\n now ", "Ünï 😀 x\x00y", "a" * 700, "12345 678", "​ ", "the the the", "the the the"]


@pytest.mark.parametrize("block", [40, 8 << 20])
def test_bpe_equals_tiktoken_and_decodes_back(documents, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(ODD))
    docs = documents(rows).union(documents(rows)).withColumn("ids", F.lit("clash"))  # every row twice
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([i for i, _ in rows] * 2)
    for r in got:
        text = ODD[r["doc_id"]] or ""
        assert bytes(r["ids"]) == b"".join(struct.pack("<I", i) for i in plain.encode_ordinary(text))
        assert bytes(r["decoded"]).decode() == text
    assert bpe.encode(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_words_merge_as_short_ones():
    ranks, rng = bpe.read_ranks(PATH), random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"abetnio ") for _ in range(rng.randrange(2, 90)))
        if word not in ranks:
            assert bpe._merge_long(word, ranks) == bpe.merge_word(word, ranks)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_contamination(docs, items, size):
    test = {(i, tuple(w[k : k + size])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - size + 1))}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, win in test:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [3, 500_000])
def test_contamination(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "WINDOW_BLOCK", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(12)] + [(20, None), (21, ""), (22, "É w1"), (10, "w1 w2")]
    docs = list(enumerate([" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(40)] + [None, "", "é W1", "É-W1, w2!", "w1" * 50]))
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("clash"))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(documents(docs).withColumn("items", F.lit(1)), table, 4).collect()}
    assert got == brute_contamination(docs, items, 4)
    assert decontaminate.contamination(documents([]), table).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(documents(docs), table.limit(0)).collect())


def test_proximity(spark, documents):
    docs = documents(["b x a y c", "a b c", "a " + "x " * 30 + "b c", "a b"])
    item = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = decontaminate.proximity_matches(decontaminate.build_index(docs), item, 3, 5).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1]


def test_cuts_by_class_are_the_pattern_s(monkeypatch):
    import regex

    from chorus.llm import tokens

    monkeypatch.setattr(tokens, "PIECE", 64)
    assert bpe.BY_CLASS == public_tokenizers.PATTERN
    rng = random.Random(4)
    pools = ["ab1' \n\t.,é漢 ", "'strevmld x1 ", "' \n's", " \u00a0\x1c\x85ab", "aÀ٣½²'ǅ\u0301🙂 "]
    odd = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\nb c", "it 's 'll", "x  y", "don't  stop", "'s", "'", "x'", "'re'r", "''s", "1's", "\n's \n 's", "we'll've'dx", "'S"]
    texts = [*odd, *("".join(rng.choices(pool, k=rng.randint(0, 30))) for pool in pools for _ in range(1500)), "a" * 300, "'s" * 200]
    find = regex.compile(bpe.BY_CLASS).findall
    for part in ([t] for t in odd):
        number, size, words = bpe._split(part, bpe.BY_CLASS)
        assert [words[i] for i in number] == find(part[0]) and size.tolist() == [len(number)]
    for at in range(0, len(texts), 700):  # texts one after another do not reach into each other
        part = texts[at : at + 700]
        number, size, words = bpe._split(part, bpe.BY_CLASS)
        cut = np.r_[0, np.cumsum(size)]
        assert [[words[i] for i in number[a:z]] for a, z in zip(cut[:-1], cut[1:], strict=True)] == [find(t) for t in part]
        assert len(set(words)) == len(words)
    assert bpe._split(["a b", "", "b"], r"\w")[0].tolist() == [0, 1, 1]


@pytest.mark.parametrize("slice_", [1, 7, 1 << 19])
def test_blocks_in_slices_are_whole(monkeypatch, slice_):
    monkeypatch.setattr(bpe, "SLICE", slice_)
    texts = ["", "a b a", "it's  here", "", "", "B" * 30, " a\n\n b ", "\u00e9 \U0001f600 a", "it's", ""]
    find = regex.compile(bpe.BY_CLASS).findall
    number, size, words = bpe._split(texts, bpe.BY_CLASS)
    assert len(set(words)) == len(words)
    assert [words[n] for n in number] == [w for t in texts for w in find(t)] and size.tolist() == [len(find(t)) for t in texts]
    tokenizer = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    # the steps of encode() in this process, where the slices are set
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    asked = pa.Table.from_batches(bpe._asked(public_tokenizers.PATTERN, 3)([rows]))
    answered = pa.concat_tables([bpe._answered(PATH)(asked.slice(i, 1)) for i in range(asked.num_rows)])
    got = bpe._assembled(pa.Table.from_batches(bpe._positions(public_tokenizers.PATTERN, 3)([rows])), answered)
    assert got.column("doc_id").to_pylist() == list(range(len(texts)))
    assert got.column("ids").to_pylist() == [struct.pack(f"<{len(x)}I", *x) for x in map(tokenizer.encode_ordinary, texts)]


def test_a_block_is_cut_in_little_memory():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(bpe.BLOCK_CHARS // 2200)]
    bpe._split(texts[:1], bpe.BY_CLASS)  # the tables that are made once
    tracemalloc.start()
    try:
        bpe._split(texts, bpe.BY_CLASS)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * bpe.BLOCK_CHARS  # 19 times before


def python_steps_in_a_stage(plan):
    most, above = 0, []  # above: (depth, Python steps of the stage so far)
    for line in plan.splitlines():
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        while above and above[-1][0] >= depth:
            above.pop()
        steps = 0 if node.startswith("Exchange") else (above[-1][1] if above else 0) + ("InArrow" in node.split(" ")[0])
        above.append((depth, steps))
        most = max(most, steps)
    return most


def test_no_task_holds_two_python_workers(spark, documents):
    docs = documents([(i, t) for i, t in enumerate(ODD)] * 2)
    items = spark.createDataFrame([("x", "a b c")], "item_id string, text string")
    tokens = stages.tokens_of(docs, PATH, public_tokenizers.PATTERN)
    both = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    for out, steps in ((tokens, 1), (decontaminate.contamination(docs, items, 2), 1), (both, 2)):
        assert python_steps_in_a_stage(out._jdf.queryExecution().executedPlan().toString()) == steps
    want = sorted((r["doc_id"], len(r["ids"]) // 4, sha256(r["ids"]).hexdigest(), sha256(r["decoded"]).hexdigest()) for r in both.collect())
    assert sorted(map(tuple, tokens.collect())) == want
    assert stages.tokens_of(documents([]), PATH, public_tokenizers.PATTERN).count() == 0
