"""A corpus pipeline of five stages over documents, each on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet and
reads it again as the next stage's docs.  All stages but the last return the columns of documents, others than doc_id,
text, source and n_chars as they are, whatever their names.  Null and blank texts are scored, link with nothing, lose
nothing, are mixed 0 times (so are all documents without words), and rows of null or repeated doc_id are documents of
their own; texts of any length are read whole; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import jaccard, mixing, packing, suffix, toxicity
from logweave.llm.common import clear, stored, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxicity_score_ < 0.3").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are linked by a 5-gram Jaccard similarity of 0.75, that with the smallest doc_id stays, null last.

    Rows are told apart by a number of their own: of linked rows that share a doc_id, or have none, one stays too, and rows
    of one doc_id whose texts are not linked all stay.
    """
    rows = stored(docs.withColumn("row_", F.monotonically_increasing_id()), "rows")
    groups = jaccard.jaccard_join(rows.select(F.col("row_").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_"), "component_id")
    ids = rows.select("row_", "doc_id").join(groups, "row_")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_"))["row_"].alias("first_"))
    return rows.join(first.hint("shuffle_hash"), F.col("row_") == F.col("first_"), "left_semi").select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside strings of 100 bytes that start earlier go; n_chars follows the text."""
    cut = suffix.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Training a classifier and cutting bytes by earlier occurrence are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        clear(spark, keep=docs, before=before)  # the table of the stage before, and what this one wrote on its way
    return docs
