"""Stages of the pipeline on rows that share a doc_id or have none."""

import collections

import corpus_pipeline
from logweave.llm import mixing

DOCS = "doc_id long, text string, source string"
WORDS = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcde"]


def test_one_row_of_each_group_stays(spark):
    a, b, d, e, f = WORDS
    rows = [(1, a), (1, a), (2, a + " x"), (None, a), (None, b), (None, b), (3, d), (3, e), (5, f), (4, f + " y"), (None, f), (6, ""), (6, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    got = collections.Counter(tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").select("doc_id", "text").collect())
    assert got == collections.Counter([(1, a), (None, b), (3, d), (3, e), (4, f + " y"), (6, ""), (6, ""), (7, None)])


def test_rows_of_one_id_are_mixed_each(spark):
    docs = spark.createDataFrame([(i % 3 if i % 4 else None, " ".join(f"r{i}w{k}" for k in range(5 + i % 7)), "ab"[i % 2]) for i in range(60)], DOCS)
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    got = collections.Counter(r["text"] for r in mixing.mixed_rows(docs).collect())
    assert sum(got.values()) == want and max(got.values()) <= 3
