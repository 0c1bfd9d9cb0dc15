"""Runtime logs: lines, locations, records, and matching against templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import text as t

#: Lines back that may hold a dominator's event.
LOOKBACK = 10


def parse_log_lines(lines: DataFrame, line: str = "line", form: t.LogFormat = t.LogFormat()) -> DataFrame:
    """lines with ts, file_name and line_number; malformed lines are skipped.  form: the lines' format."""
    rows = lines.where(F.col(line).rlike(form.pattern))
    return rows.withColumns(t.parse_log_line(F.col(line), form)).where("ts is not null and line_number is not null")


def log_loc_join(lines: DataFrame, statements: DataFrame, order: str = "event_id") -> DataFrame:
    """Parsed lines with the event_id of the statement at their location; of several there, the last in order."""
    at = statements.groupBy("file_name", "line_number").agg(F.max_by("event_id", order).alias("event_id"))
    return lines.join(at, ["file_name", "line_number"])


def multiline_records(docs: DataFrame, key: str, text: str, header: str = "[A-Z]") -> DataFrame:
    """(key, record_no, record): a record begins at a line that starts with the header; lines before the first are none's."""
    pieces = docs.select(key, F.posexplode(F.split(text, rf"\n(?={header})")).alias("piece", "record"))
    first = F.regexp_extract(F.col("record"), rf"\A({header})", 1) != ""
    return pieces.where((F.col("piece") > 0) | first).select(key, F.col("piece").alias("record_no"), "record")


def template_match(messages: DataFrame, templates: DataFrame, *, top: int = 1, variable: str = t.PLACEHOLDER) -> DataFrame:
    """messages with template_id, values and score of their best templates: of each row, at most `top`.

    templates(template_id, template) are those of a program, and become constant patterns, tried within the row: nothing
    is shuffled, so repeated and common messages cost no more than others.  The score is the share of a message that is
    literal text; ties go to the smaller template_id, and empty and null messages match nothing.  variable: the pattern
    of a placeholder.
    """
    kinds = templates.select("template_id", t.template_regex(F.col("template"), variable).alias("pattern"), F.size(t.variables(F.col("template"), variable)).alias("groups")).orderBy("template_id").collect()
    size, tried = F.length("message"), []
    for kind in kinds:
        values = F.array(*[F.regexp_extract("message", kind["pattern"], i + 1) for i in range(kind["groups"])]).cast("array<string>")
        score = F.try_divide(size - F.aggregate(values, F.lit(0), lambda a, x: a + F.length(x)), size)
        hit = F.struct((-score).alias("rank"), F.lit(kind["template_id"]).alias("template_id"), values.alias("values"))
        tried.append(F.when(F.col("message").rlike(kind["pattern"]) & (size > 0), hit))
    if not tried:
        kind = templates.schema["template_id"].dataType
        return messages.limit(0).select("*", F.lit(None).cast(kind).alias("template_id"), F.lit(None).cast("array<string>").alias("values"), F.lit(None).cast("double").alias("score"))
    best = F.slice(F.array_sort(F.filter(F.array(*tried), lambda x: x.isNotNull())), 1, top)
    hits = messages.withColumn("hit_", F.explode(best))
    return hits.select(*messages.columns, F.col("hit_.template_id").alias("template_id"), F.col("hit_.values").alias("values"), (-F.col("hit_.rank")).alias("score"))


def lookback_values(events: DataFrame, parents: dict, *, lookback: int = LOOKBACK, by_type: bool = False) -> DataFrame:
    """(stream, seq, values): each event's own values and those of its dominators' events in the lookback, recursively.

    events(stream, seq, type, value), one row for each value of an event, null if it has none; parents: from types to
    those of their idoms.  A step joins events with those of the parent's type at most `lookback` before them, by stream,
    type and blocks of `lookback` places, so a long stream is no single task; states are distinct by step.  by_type: an
    event has several types, and values of its own for each: (stream, seq, type, values).
    """
    kind = events.schema["type"].dataType
    idom = F.lit(None).cast(kind)
    if parents:
        idom = F.element_at(F.create_map(*[F.lit(x).cast(kind) for pair in parents.items() for x in pair]), F.col("at_type"))
    block = lambda x: F.floor(x / lookback)
    own = ["stream", "seq", "type"] if by_type else ["stream", "seq"]
    earlier = events.select(F.col("stream").alias("s"), F.col("seq").alias("then"), F.col("type").alias("kind"), F.col("value").alias("theirs"), block(F.col("seq")).alias("b"))
    state = events.select(*own, F.col("seq").alias("at"), F.col("type").alias("at_type")).distinct()
    out = events.select(*own, "value")
    for _ in range(height(parents)):
        ask = state.select(*own, "at", idom.alias("wanted")).where("wanted is not null").distinct()
        ask = ask.withColumn("b", F.explode(F.array(block(F.col("at")), block(F.col("at")) - 1)))
        match = F.col("stream").eqNullSafe(F.col("s")) & (F.col("wanted") == F.col("kind")) & (ask["b"] == earlier["b"])
        hit = ask.join(earlier, match).where((F.col("then") < F.col("at")) & (F.col("then") >= F.col("at") - lookback))
        hit = hit.select(*own, F.col("then").alias("at"), F.col("kind").alias("at_type"), F.col("theirs").alias("value"))
        out = out.union(hit.select(*own, "value"))
        state = hit.drop("value").distinct()
    return out.groupBy(*own).agg(F.sort_array(F.collect_set("value")).alias("values"))


def height(parents: dict) -> int:
    """How many steps up the longest chain of parents has; one that runs in a circle ends after as many as there are."""
    most = 0
    for child in parents:
        n, k = 0, child
        while k in parents and n <= len(parents):
            n, k = n + 1, parents[k]
        most = max(most, n)
    return most


def log_calls(callee: Column, args: Column) -> Column:
    """Whether a call is one of a logger: a target that holds log, a level's name, and arguments."""
    target, name = F.regexp_extract(callee, r"^(.*)\.(\w+)$", 1), F.regexp_extract(callee, r"^(.*)\.(\w+)$", 2)
    return F.lower(target).contains("log") & F.upper(name).isin(t.LEVELS) & (F.length(F.trim(args)) > 0)
