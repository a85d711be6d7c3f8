"""Operators against brute-force Python on random inputs (hypothesis)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorus.functions.columns import contains_ci
from chorus.operators import duplicates as du
from chorus.operators import ingest as ig

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
TEXT = st.text(alphabet="abcABC xyz_%é-", max_size=12)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3", "k4"]), TEXT), min_size=1, max_size=40))
def test_first_write_wins_matches_python(spark, rows):
    data = [(k, i, c) for i, (k, c) in enumerate(rows)]  # arrival = position, unique
    df = spark.createDataFrame(data, "message_id string, arrival long, content string")
    got = {r.message_id: (r.arrival, r.content) for r in ig.first_write_wins(df, "message_id", ("arrival",)).collect()}
    expected = {}
    for k, i, c in data:
        expected.setdefault(k, (i, c))
    assert got == expected


def _tokens(s: str) -> set[str]:
    return {t for t in re.split(r"\W+", s.lower(), flags=re.ASCII) if t}


@SETTINGS
@given(st.lists(st.text(alphabet="ab cd,E.f", max_size=15), min_size=1, max_size=20), st.text(alphabet="ab cd,E.f", max_size=15))
def test_jaccard_matches_python(spark, summaries, new):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(summaries)], "id long, summary string")
    got = {r.id: r.score for r in du.duplicate_bugs(df, new, threshold=0.0).collect()}
    expected = {}
    q = _tokens(new)
    for i, s in enumerate(summaries):
        t = _tokens(s)
        if t | q:
            expected[i] = len(t & q) / len(t | q)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def _like_contains(text: str, q: str) -> bool:
    pat = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in q.lower())
    return re.search(pat, text.lower(), flags=re.DOTALL) is not None


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=30), st.text(alphabet="aBc_%é", min_size=1, max_size=4))
def test_search_like_matches_python(spark, texts, q):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = sorted(r.i for r in df.filter(contains_ci(F.col("t"), q)).collect())
    assert got == [i for i, t in enumerate(texts) if _like_contains(t, q)]
