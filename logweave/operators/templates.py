"""The template parser: log lines to the templates that wrote them, with the values of their dominators' events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import text as t
from logweave.operators.graph import ancestor_variables
from logweave.operators.logs import LOOKBACK, lookback_values, template_match

#: The default format: a record is a line, and all of it is the message.
FORMAT = "(.*)"


def messages(lines: DataFrame, form: str = FORMAT) -> DataFrame:
    """lines(file, line_no, line) with message: the format's groups, joined by a space; lines that lack it are none."""
    parts = [F.regexp_extract("line", form, i) for i in range(1, _groups(form) + 1)]
    return lines.where(F.col("line").rlike(form)).withColumn("message", F.concat_ws(" ", *parts) if parts else F.lit(""))


def _groups(form: str) -> int:
    """How many groups a pattern has."""
    at, n, within = 0, 0, False
    while at < len(form):
        if form[at] == "\\":
            at += 1
        elif form[at] in "[]":
            within = form[at] == "["
        elif form[at] == "(" and not within and (form[at + 1 : at + 2] != "?" or form[at + 1 : at + 3] == "?<" and form[at + 3 : at + 4] not in "=!"):
            n += 1
        at += 1
    return n


def parse_logs(lines: DataFrame, templates: DataFrame, *, form: str = FORMAT, variable: str = t.PLACEHOLDER, lookback: int = LOOKBACK, top: int = 1) -> DataFrame:
    """(file, line_no, template_id, values) of the lines of logs that a template matches.

    values: those of the event and of its dominators' events in the `lookback` messages before it, recursively.
    templates(idom_id, template_id, template).
    """
    found = template_match(messages(lines, form).select("file", "line_no", "message"), templates, top=top, variable=variable)
    parents = {r[0]: r[1] for r in templates.where("idom_id is not null").select("template_id", "idom_id").collect()}
    events = found.select(F.col("file").alias("stream"), F.col("line_no").cast("long").alias("seq"), F.col("template_id").alias("type"), F.explode_outer("values").alias("value"))
    named = lookback_values(events, parents, lookback=lookback, by_type=True)
    return named.select(F.col("stream").alias("file"), F.col("seq").alias("line_no"), F.col("type").alias("template_id"), "values")


def as_json(parsed: DataFrame) -> DataFrame:
    """(file, line_no, value): of each line one JSON object, from template ids to values."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("template_id").cast("string").alias("key"), F.col("values").alias("value"))))
    return parsed.groupBy("file", "line_no").agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def template_stat(templates: DataFrame, variable: str = t.PLACEHOLDER) -> DataFrame:
    """(idom_id, template_id, names, above): the variables of templates, and those of their dominators, nearest first."""
    rows = templates.select("idom_id", F.col("template_id").alias("event_id"), "template")
    named = ancestor_variables(rows, variable).select(F.col("event_id").alias("template_id"), "names", "above")
    return templates.select("idom_id", "template_id").join(named, "template_id").select("idom_id", "template_id", "names", "above")


def as_lists(stat: DataFrame) -> DataFrame:
    """template_stat with lists as text, as in ['UserId0', 'Count1'], and a missing idom as nothing."""
    shown = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))
    return stat.select(F.coalesce(F.col("idom_id").cast("string"), F.lit("")).alias("idom_id"), F.col("template_id").cast("string").alias("template_id"), shown("names").alias("names"), shown("above").alias("above"))
