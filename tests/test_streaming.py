"""Streams against their batch versions."""

import random

from pyspark.sql import functions as F

from logweave.operators.logs import lookback_values
from logweave.operators.sequences import rolling_sequences
from logweave.sources.tables import scratch
from logweave.streaming.logs import drain
from logweave.streaming.sequences import stream_lookback_values, stream_rolling_sequences


def arriving(spark, rows, schema, files):
    """rows as a table and as a stream of files, each in a trigger of its own."""
    folder = scratch(spark, "in")
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(a) == key(b) and a.count() > 0


def test_rolling(spark):
    r = random.Random(3)
    us = sorted(r.randrange(600) for _ in range(60))
    rows = [(r.choice("ab"), t, i, r.randrange(5)) for i, t in enumerate(us)]
    table, stream = arriving(spark, rows, "stream string, us long, seq long, item int", 3)
    batch = rolling_sequences(table, window_us=40, longest=4).select("stream", F.col("seq").cast("long").alias("seq"), "items")
    same(batch, drain(stream_rolling_sequences(stream, window_us=40, longest=4)))


def test_lookback(spark):
    r, seen, rows = random.Random(4), {"a": 0, "b": 0}, []
    for i in range(80):
        s = r.choice("ab")
        rows.append((s, seen[s], r.choice(["x", "y", "z"]), f"v{i % 9}"))
        seen[s] += 1
    table, stream = arriving(spark, rows, "stream string, seq long, type string, value string", 3)
    parents = {"y": "x", "z": "y"}
    same(lookback_values(table, parents, lookback=3), drain(stream_lookback_values(stream, parents, lookback=3)))


def test_rows_that_wait(spark):
    """Rows come up to 50 out of order, over triggers; a last row of each stream lets all others go."""
    r = random.Random(5)
    rows = [(r.choice("ab"), t, t, t % 7) for t in range(0, 400, 3)]
    late = sorted(rows, key=lambda x: x[1] + r.randrange(50)) + [("a", 9000, 0, 0), ("b", 9000, 0, 0)]
    schema = "stream string, us long, seq long, item int"
    _, stream = arriving(spark, late, schema, 5)
    batch = rolling_sequences(spark.createDataFrame(rows, schema), window_us=40, longest=4).select("stream", F.col("seq").cast("long").alias("seq"), "items")
    same(batch, drain(stream_rolling_sequences(stream, window_us=40, longest=4, delay_us=60)))
