"""Streaming versions of the log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.operators.logs import parse_log_lines
from logweave.sources.tables import scratch


def stream_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files that arrive in a folder, parsed as they come; an unbounded DataFrame."""
    return parse_log_lines(spark.readStream.schema("value string").text(folder), "value")


def drain(stream: DataFrame) -> DataFrame:
    """What a stream yields of all that has arrived, as a table: one run with a checkpoint, so a restart repeats nothing."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
