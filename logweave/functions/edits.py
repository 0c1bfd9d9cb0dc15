"""Column functions over ranges of source text; places count characters from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.text import min_indent


def within(text: Column, begin: Column | int, end: Column | int) -> Column:
    """The text from one place up to another; null if the range does not lie in the text."""
    begin, end = (x if isinstance(x, Column) else F.lit(x) for x in (begin, end))
    return F.when((begin >= 0) & (begin <= end) & (end <= F.length(text)), F.substr(text, begin + 1, end - begin))


def insert(text: Column, at: Column | int, new: Column) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.concat(F.substr(text, F.lit(1), at), new, F.substr(text, at + 1))


def delete(text: Column, begin: Column | int, end: Column | int) -> Column:
    begin, end = (x if isinstance(x, Column) else F.lit(x) for x in (begin, end))
    return F.concat(F.substr(text, F.lit(1), begin), F.substr(text, end + 1))


def apply_edits(text: Column, edits: Column) -> Column:
    """text with edits, an array of (begin, end, new): each range of the text as it was is replaced.

    Ranges must not overlap; of those at one place the first in the array comes first.
    """
    placed = F.transform(edits, lambda e, i: F.struct(e["begin"].alias("begin"), i.alias("no"), e["end"].alias("end"), e["new"].alias("new")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, e: F.struct(e["end"].cast("int").alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, e["begin"].cast("int") - s["at"]), e["new"]).alias("out"))
    done = F.aggregate(F.array_sort(placed), start, step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1))


def block_start(text: Column, at: Column) -> Column:
    """Where the spaces and tabs before a place begin."""
    return at - F.length(F.regexp_extract(F.reverse(F.substr(text, F.lit(1), at)), r"^[ \t]*", 0))


def deindent(text: Column) -> Column:
    """text without the least indentation of its lines that are not blank; blank lines lose as much as they have of it."""
    least = F.coalesce(min_indent(text), F.lit(0))
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) >= least, F.substr(x, least + 1)).otherwise(F.lit(""))), "\n")
