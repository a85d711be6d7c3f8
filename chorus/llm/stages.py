"""Stages of a corpus pipeline: each keeps or changes rows of documents.

Every function takes documents and returns documents with the same columns
(the last one returns the tokens).  ``n_chars`` follows the text where the
table has it.  Rows are judged by their doc_id: rows that share one are kept or
dropped together.  Null texts count as empty; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm import bpe, decontaminate, line_dedup, ngram_jaccard, quality
from chorus.llm.common import stored

NEAR_WORDS, NEAR_PERCENT = 5, 80


def _keeping(docs: DataFrame, judged: DataFrame, kept: Column, name: str) -> DataFrame:
    """Rows of docs whose doc_id one of judged's rows keeps; judged has every doc_id.

    The ids that go are stored and joined: they are fewer than those that stay, so texts
    are not dealt by id while Spark can send the ids instead."""
    gone = judged.groupBy(F.col("doc_id").cast("long").alias("_chorus_id")).agg(F.max(F.coalesce(kept, F.lit(False))).alias("stays")).filter("not stays").select("_chorus_id")
    return docs.filter(F.col("doc_id").isNotNull()).join(stored(gone, name), F.col("doc_id").cast("long") == F.col("_chorus_id"), "left_anti")


def good_quality(docs: DataFrame, labels: DataFrame, learns: Column | None = None, reject_below: float = 0.7) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    scored = quality.quality_scores(docs, labels, learns=learns)
    return _keeping(docs, scored, F.col("score") >= reject_below, "stage-quality")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Texts without the lines that a document with a smaller id holds too."""
    out = line_dedup.without_repeated_lines(docs)
    changed = F.col("n_dropped") > 0
    columns = []
    for c in docs.columns:
        old = F.col(f"doc.`{c}`")
        new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema[c].dataType)}.get(c)
        columns.append((old if new is None else F.when(changed, new).otherwise(old)).alias(c))
    return out.select(*columns)


def one_of_each_group(docs: DataFrame, words: int = NEAR_WORDS, percent: int = NEAR_PERCENT) -> DataFrame:
    """Of documents linked by near-equal shingle sets, the one with the smallest id."""
    found = ngram_jaccard.linked_components(docs, words, percent)
    return _keeping(docs, found, F.col("doc_id") == F.col("component_id"), "stage-near")


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(docs, benchmark)
    return _keeping(docs, found, ~F.col("contaminated"), "stage-clean")


def tokens_of(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    out = bpe.encode_and_decode(docs, ranks_path, pattern)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
