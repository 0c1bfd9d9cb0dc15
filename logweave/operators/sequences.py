"""Rolling event sequences, and the support of paths and patterns in them."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.sources.tables import stored


def rolling_sequences(events: DataFrame, *, window_us: int, shortest: int = 2, longest: int = 16, limit: int = 0, block_us: int = 0) -> DataFrame:
    """(stream, seq, items): for each event those of the last window_us up to it, oldest first, at most `longest`.

    events(stream, us, seq, item), in order of us and seq; later events of the same time are not in the window.  limit:
    windows of a stream's first events only.

    A stream is cut into blocks of time of block_us, 64 windows unless given, which are counted before they are shuffled,
    so a busy stream is no single task.  Events are numbered along the stream, and so are the times at which their windows
    begin, which gives the number of the first event in each; that event brings the items from it on.  No task holds more
    of a window than `longest` events at a time.
    """
    span = max(block_us or 64 * window_us, window_us)
    rows = stored(events.select("stream", "us", "seq", "item").withColumn("id", F.monotonically_increasing_id()), "events")
    block = lambda us: F.floor(us / F.lit(span))
    # Events, and marks where their windows begin, before the events of that time.
    own = rows.select("stream", "us", F.lit(1).alias("kind"), "seq", "item", "id")
    mark = rows.select("stream", (F.col("us") - window_us + 1).alias("us"), F.lit(0).alias("kind"), "seq", F.lit(None).cast(rows.schema["item"].dataType).alias("item"), "id")
    both = own.union(mark).withColumn("block", block(F.col("us")))
    marked = both.groupBy("stream", "block").agg(F.sum("kind").alias("n"))
    earlier = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.select(F.col("stream").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("stream", "block").orderBy("us", "kind", "seq", "id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn("local", F.sum("kind").over(inside)).join(marked, F.col("stream").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    numbered = stored(numbered.select("stream", "block", "us", "kind", "seq", "item", "id", "local", (F.col("before") + F.col("local")).alias("rn")), "numbered")

    # Each event's items from it on: a window reaches into the next block at most, whose first events are lent.
    event = numbered.where("kind = 1").select("stream", "block", "us", "seq", "id", "item", "rn", F.lit(True).alias("own"))
    lent = numbered.where((F.col("kind") == 1) & (F.col("local") < longest)).select("stream", (F.col("block") - 1).alias("block"), "us", "seq", "id", "item", "rn", F.lit(False).alias("own"))
    onward = Window.partitionBy("stream", "block").orderBy("us", "seq", "id").rowsBetween(0, longest - 1)
    held = event.union(lent).withColumn("held", F.collect_list(F.struct("rn", "item")).over(onward)).where("own")
    held = held.select(F.col("stream").alias("s"), F.col("rn").alias("first"), "held")
    begin = numbered.where("kind = 0").select(F.col("id").alias("of"), F.col("stream").alias("st"), (F.col("rn") + 1).alias("begin"))
    last = event.select("id", "stream", "rn")
    if limit > 0:
        last = last.where(F.col("rn") <= limit)
    found = last.join(begin, F.col("id") == F.col("of")).join(held, F.col("st").eqNullSafe(F.col("s")) & (F.col("begin") == F.col("first")))
    items = F.transform(F.filter("held", lambda x: x["rn"] <= F.col("rn")), lambda x: x["item"])
    return found.select("stream", F.col("rn").alias("seq"), items.alias("items")).where(F.size("items") >= shortest)


def contains(items: Column, path: Column) -> Column:
    """Whether a path's items occur in order, with any gaps."""
    step = lambda i, x: F.when((i < F.size(path)) & (x == F.get(path, i)), i + 1).otherwise(i)
    return F.aggregate(items, F.lit(0), step) == F.size(path)


def path_support(sequences: DataFrame, paths: DataFrame, *, support: int = 16) -> DataFrame:
    """(path, support) of paths(path) of two items or more that at least `support` sequences contain.

    Sequences meet paths by the paths' last item, which for paths of a forest is one leaf's; no patterns are mined.  Equal
    sequences are counted first, and Spark broadcasts the paths only if they are small.
    """
    kinds = sequences.groupBy("items").agg(F.count("*").alias("times"))
    ends = kinds.select("items", "times", F.explode(F.array_distinct("items")).alias("last"))
    wanted = paths.where(F.size("path") >= 2).distinct().select("path", F.element_at("path", -1).alias("last"))
    hits = ends.join(wanted, "last").where(contains(F.col("items"), F.col("path")))
    return hits.groupBy("path").agg(F.sum("times").alias("support")).where(F.col("support") >= support)


def frequent_patterns(sequences: DataFrame, *, support: int, longest: int = 16) -> DataFrame:
    """(path, support) of all patterns that at least `support` sequences contain."""
    rows = sequences.select(F.transform("items", lambda x: F.array(x)).alias("sequence"))
    n = rows.count()
    if n < support or not n:
        return sequences.select(F.col("items").alias("path"), F.lit(0).cast("long").alias("support")).limit(0)
    span = PrefixSpan(minSupport=(support - 0.5) / n, maxPatternLength=longest, sequenceCol="sequence")
    found = span.findFrequentSequentialPatterns(rows)
    return found.select(F.transform("sequence", lambda x: x[0]).alias("path"), F.col("freq").alias("support")).where(F.col("support") >= support)
