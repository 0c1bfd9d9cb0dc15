"""Column functions over templates, variable names and log lines."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of a log call, level names of changed calls, endings of identifier names.
LEVELS = ["FATAL", "ERROR", "WARN", "INFO", "DEBUG", "TRACE", "LOG"]
CALL_LEVELS = ["log", "fatal", "error", "warning", "info", "debug", "trace"]
ID_PATTERN = r"(?:[iI]d|[pP]ath|[aA]ddress|[hH]ost|[iI]p|[nN]ame|[uU]rl|[uU]ri)(?![a-z])"
LOG_LINE = r"(?d)^([\d -:,]+) .*? \((\w+.java):.+?\((\d+)\)\) .*?$"
CALL_PATTERN = r"(?<![\w.])((?:\w*[Ll][Oo][Gg]\w*\.)+(?:" + "|".join(CALL_LEVELS) + r"))\s*\((?!\s*\))"
LITERALS = r'"(?:\\.|[^"\\])*"' + r"|'(?:\\.|[^'\\])*'"
COMMENTS = r"/\*[\s\S]*?\*/|//.*"
PLACEHOLDER = r"(?<!\\)\{(\w*)\}"
SLF4J, PRINTF = r"(?<!\\)\{\}", r"(?<!\\)%\S+"


def is_id(name: Column) -> Column:
    """Whether a word of the name, in camel case, ends like an identifier."""
    return name.rlike(ID_PATTERN)


def code(text: Column) -> Column:
    """Source text whose string and character literals are empty, and without comments."""
    return F.regexp_replace(F.regexp_replace(text, LITERALS, '""'), COMMENTS, " ")


def variables(template: Column, pattern: str = PLACEHOLDER) -> Column:
    """Names of a template's placeholders, in order; escaped braces hold none.  pattern: its first group is the name."""
    return F.regexp_extract_all(template, F.lit(pattern), F.lit(1))


def escape(text: Column) -> Column:
    """Literal text as it stands in a template."""
    return F.replace(F.replace(F.replace(text, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), F.lit("\n"), F.lit("\\n"))


def normalise_name(name: Column) -> Column:
    """Words of a name, without a leading get, capitalised and joined; directly repeated parts stand once."""
    words = F.filter(F.transform(F.split(name, "[^A-Za-z]+"), lambda w: F.regexp_replace(w, "^get", "")), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.regexp_replace(joined, r"(.{2,})(?:\1)+", "$1")


def placeholder_names(names: Column) -> Column:
    """Placeholders of a statement's arguments: a name or var, and the ordinal."""
    return F.transform(names, lambda v, i: F.concat(F.lit("{"), F.when(v == "", F.lit("var")).otherwise(v), i.cast("string"), F.lit("}")))


def fill_placeholders(text: Column, args: Column, pattern: str = SLF4J) -> Column:
    """text with its n-th placeholder replaced by the n-th argument; surplus ones of either kind are left or dropped."""
    pieces = F.split(text, pattern)
    marks = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    filled = F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, F.coalesce(F.try_element_at(args, i + 1), F.try_element_at(marks, i + 1))).otherwise(F.lit(""))))
    return F.array_join(filled, "")


def template_regex(template: Column, pattern: str = PLACEHOLDER) -> Column:
    """An anchored pattern of a template: literal parts as they are, placeholders as groups, any space between."""
    unescape = lambda x: F.regexp_replace(F.replace(x, F.lit("\\n"), F.lit("\n")), r"\\([{}])", "$1")
    parts = F.transform(F.split(template, pattern), lambda x: F.concat(F.lit("\\Q"), F.trim(unescape(x)), F.lit("\\E")))
    return F.concat(F.lit(r"^\s*"), F.array_join(parts, r"\s*(.*)\s*"), F.lit(r"\s*$"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def indentation(line: Column) -> Column:
    """How many spaces and tabs a line begins with."""
    return F.length(line) - F.length(F.regexp_replace(line, r"^[ \t]+", ""))


def min_indent(text: Column) -> Column:
    """The least indentation of the lines that are not blank; null if all are."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]+", "") != "")
    return F.array_min(F.transform(lines, indentation))


class LogFormat(NamedTuple):
    """How a log line is read: a pattern of the whole line, whose groups are the time, the file and the line number."""

    pattern: str = LOG_LINE
    time: Callable[[Column], Column] = lambda x: F.translate(x, ",", ".").try_cast("timestamp_ntz")


def parse_log_line(line: Column, form: LogFormat = LogFormat()) -> dict[str, Column]:
    """ts, file_name and line_number of a line that the format's pattern matches; null where a value is malformed.

    One pass of the pattern over the line puts its groups between marks, with none in the first and last of them.
    """
    marked = F.regexp_replace(line, form.pattern, "$1\x01$2\x01$3")
    first, last = F.substring_index(marked, "\x01", 1), F.substring_index(marked, "\x01", -1)
    middle = F.substr(marked, F.length(first) + 2, F.length(marked) - F.length(first) - F.length(last) - 2)
    return {"ts": form.time(first), "file_name": middle, "line_number": last.try_cast("int")}
