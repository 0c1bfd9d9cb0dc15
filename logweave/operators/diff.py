"""Changes of log calls in diffs: hunk_lines(commit, hunk, line_no, origin, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import text as t

OLD, NEW, REVISED = "-", "+", "~"


#: What a hunk is one of, where lines have these columns.
HUNK = ("commit", "parent_no", "path", "hunk")


def java_lines(lines: DataFrame) -> DataFrame:
    """The lines of patches of text files whose new path ends with .java, from lines with is_binary and path."""
    return lines.where(~F.col("is_binary") & F.col("path").endswith(".java"))


def diff_spans(lines: DataFrame) -> DataFrame:
    """(the hunk's columns, side, span, n_lines, changes, text): runs of a side's lines whose parentheses balance.

    A hunk is one of a commit, and of a parent and a path where lines have such columns.  A side has its own lines, the
    common ones, and the marks of a missing end of line; a run that is still open at the hunk's end is no span.
    """
    hunk = [x for x in HUNK if x in lines.columns]
    sides = lines.withColumn("side", F.explode(F.array(F.lit(OLD), F.lit(NEW)))).where(F.col("origin").isin(" ", "<", "=", ">") | (F.col("origin") == F.col("side")))
    balance = F.length(F.regexp_replace("content", r"[^(]", "")) - F.length(F.regexp_replace("content", r"[^)]", ""))
    order = Window.partitionBy(*hunk, "side").orderBy("line_no")
    rows = sides.withColumn("sum", F.sum(balance).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("span", F.coalesce(F.sum((F.col("sum") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    spans = rows.groupBy(*hunk, "side", "span").agg(F.sort_array(F.collect_list(F.struct("line_no", "origin", F.trim("content").alias("content")))).alias("lines"), F.max_by("sum", "line_no").alias("last"))
    join = lambda part, sep: F.array_join(F.transform("lines", lambda x: x[part]), sep)
    return spans.where("last = 0").select(*hunk, "side", "span", F.size("lines").alias("n_lines"), join("origin", "").alias("changes"), join("content", " ").alias("text"))


def diff_log_calls(spans: DataFrame) -> DataFrame:
    """(the hunk's columns, side, span, call_no, callee, kind, has_id) of the log calls in spans that hold a change of their side.

    A callee is a whole dotted name, each of whose qualifiers holds log; it has arguments.  Calls and names in literals
    and comments are none.  has_id: whether any name in the span's code is an identifier.
    """
    hunk = [x for x in HUNK if x in spans.columns]
    changed = spans.where(F.instr("changes", "-") * (F.col("side") == OLD).cast("int") + F.instr("changes", "+") * (F.col("side") == NEW).cast("int") > 0)
    kind = F.when(F.length(F.replace("changes", "side", F.lit(""))) > 0, F.lit(REVISED)).otherwise(F.col("side"))
    calls = changed.withColumn("code", t.code(F.col("text"))).withColumn("kind", kind).withColumn("has_id", t.is_id(F.col("code")))
    return calls.select(*hunk, "side", "span", F.posexplode(F.regexp_extract_all("code", F.lit(t.CALL_PATTERN), F.lit(1))).alias("call_no", "callee"), "kind", "has_id")


def diff_track(commits: DataFrame, calls: DataFrame) -> DataFrame:
    """Per commit the old, new and revised log calls, and those with an identifier; commits without any have zeros."""
    count = lambda kind, ids: F.count_if((F.col("kind") == kind) & (F.col("has_id") if ids else F.lit(True)))
    names = {"old": OLD, "new": NEW, "rev": REVISED}
    sums = calls.groupBy("commit").agg(*[count(k, ids).alias(f"num{n}{'id' if ids else ''}") for n, k in names.items() for ids in (False, True)])
    return commits.join(sums, "commit", "left").na.fill(0)
