"""Log statements of Java sources: calls, templates, and the log call that dominates each nearest.

Every file is parsed on its own, tolerantly: what cannot be read as a log call is no log call.  Bodies of methods,
initialisers and lambdas have control-flow graphs of their own.  A file is one row and is read by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import LEVELS
from logweave.operators.dominators import immediate_dominators
from logweave.sources.tables import running_totals, stored

TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|(?P<text>"""[ \t]*\n.*?(?<!\\)"""|"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\])+\')|(?P<name>[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>->|::|[-+*/%&|^<>=!]=|\+\+|--|&&|\|\||\S)', re.S)
ESCAPE = re.compile(r"\\(u+[0-9a-fA-F]{4}|[0-7]{1,3}|.)", re.S)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " ", "\n": ""}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
FOUND = "path string, no int, idom_no int, package string, class string, method string, line_number int, level string, template string"


def literal(text: str) -> str:
    """The value of a string literal."""
    body = text.split("\n", 1)[1][:-3] if text.startswith('"""') else text[1:-1]
    if text.startswith('"""'):
        lines = body.split("\n")
        width = min((len(x) - len(x.lstrip()) for i, x in enumerate(lines) if x.strip() or i == len(lines) - 1), default=0)
        body = "\n".join(x[width:].rstrip() for x in lines)

    def value(m: re.Match) -> str:
        e = m[1]
        if e[0] == "u" and len(e) > 1:
            return chr(int(e.lstrip("u"), 16))
        return chr(int(e, 8)) if e[0] in "01234567" else ESCAPED.get(e, e)

    return ESCAPE.sub(value, body)


def name_of(text: str) -> str:
    words = (re.sub("^get", "", w) for w in re.split("[^A-Za-z]+", text))
    return "".join(w[:1].upper() + w[1:] for w in words)


class Source:
    """One file's tokens, and the log calls found so far: (line, class, method, level, template, nearest dominator)."""

    def __init__(self, text: str):
        found = [(m.lastgroup, m[0], m.start()) for m in TOKEN.finditer(text) if m.lastgroup]
        self.kind, self.text = [x[0] for x in found], [x[1] for x in found]
        self.whole, self.start = text, [x[2] for x in found]
        self.line, at, line = [], 0, 1
        for _, _, start in found:
            line += text.count("\n", at, start)
            at = start
            self.line.append(line)
        # Where each bracket closes.
        self.end: dict[int, int] = {}
        stack: list[int] = []
        for i, (k, x) in enumerate(zip(self.kind, self.text, strict=True)):
            if k == "sign" and x in OPEN:
                stack.append(i)
            elif k == "sign" and x in CLOSE:
                while stack and OPEN[self.text[stack[-1]]] != x:
                    self.end[stack.pop()] = i
                if stack:
                    self.end[stack.pop()] = i
        self.end.update(dict.fromkeys(stack, len(found)))
        self.strings = {b for a, b, k in zip(self.text, self.text[1:], self.kind[1:], strict=False) if a == "String" and k == "name"}
        self.constants: dict[str, tuple[int, int]] = {}
        self.package = ""
        self.calls: list[tuple[int, str, str, str, str, int | None]] = []
        self.waiting: list[tuple] = []
        # Variables of the template at hand; by call, its variables and the lines of its body.
        self.variables: list[tuple[str, str]] = []
        self.details: list[tuple[list[tuple[str, str]], int, int]] = []
        if "package" in self.text:
            a = self.text.index("package") + 1
            self.package = "".join(self.text[a : self.find(a, len(found), ";")])

    def find(self, i: int, stop: int, *signs: str) -> int:
        """Where one of the signs stands first from i, outside of brackets; else stop."""
        while i < stop:
            if self.kind[i] == "sign":
                if self.text[i] in signs:
                    return i
                if self.text[i] in OPEN:
                    i = self.end[i]
            i += 1
        return stop

    def split(self, a: int, b: int, sign: str) -> list[tuple[int, int]]:
        out = []
        while a < b:
            e = self.find(a, b, sign)
            out.append((a, e))
            a = e + 1
        return out

    # ------------------------------------------------------------ templates

    def bare(self, a: int, b: int) -> tuple[int, int]:
        while b - a > 1 and self.text[a] == "(" and self.end[a] == b - 1 and self.kind[a] == "sign":
            a, b = a + 1, b - 1
        return a, b

    def is_string(self, a: int, b: int) -> bool:
        a, b = self.bare(a, b)
        parts = self.split(a, b, "+")
        if len(parts) > 1:
            return any(self.is_string(*p) for p in parts)
        if b - a == 1:
            return self.kind[a] == "text" or self.text[a] in self.strings or self.text[a] in self.constants
        if self.text[a : a + 2] == ["String", "."]:
            return True
        last = self.last_call(a, b)
        if last is not None:
            return self.text[last] in ("concat", "toString", "getMessage", "getName", "name", "trim", "substring", "toLowerCase", "toUpperCase")
        return self.kind[b - 1 : b] == ["name"] and self.text[b - 1] in self.constants

    def last_call(self, a: int, b: int) -> int | None:
        """Where the name of the method stands that x.name(...) calls last."""
        i = a
        while i < b and self.end.get(i, -1) != b - 1:
            i = self.end.get(i, i) + 1
        return i - 1 if a + 1 < i < b and self.text[i] == "(" and self.kind[i - 1] == "name" and self.text[i - 2] == "." else None

    def fold(self, a: int, b: int, count: list[int], depth: int = 0) -> str:
        """The template of an expression; what is not text becomes a placeholder with the next ordinal."""
        a, b = self.bare(a, b)
        if b - a == 1 and self.kind[a] == "text":
            return literal(self.text[a]).replace("{", "\\{").replace("}", "\\}").replace("\n", "\\n")
        if b - a == 1 and self.text[a] == "null":
            return "null"
        parts = self.split(a, b, "+")
        if len(parts) > 1 and self.is_string(a, b):
            return "".join(self.fold(x, y, count, depth) for x, y in parts)
        call = self.last_call(a, b)
        if call is not None:
            args = self.split(call + 2, b - 1, ",")
            if self.text[call] == "format" and call == a + 2 and self.text[a] == "String" and args:
                if not self.is_string(*args[0]) and len(args) > 1:  # a locale
                    args = args[1:]
                return self.fill(args, r"(?<!\\)%\S+", count)
            if self.text[call] == "concat" and len(args) == 1:
                return self.fold(a, call - 1, count, depth) + self.fold(*args[0], count, depth)
        if b > a and self.text[b - 1] in self.constants and depth < 20 and all(k == "name" or x == "." for k, x in zip(self.kind[a:b], self.text[a:b], strict=True)):
            return self.fold(*self.constants[self.text[b - 1]], count, depth + 1)
        name = "".join(name_of(self.text[i]) for i in range(a, b) if self.kind[i] != "sign" and self.text[i] not in ("new", "this", "super", "instanceof"))
        name = re.sub(r"(.{2,})(?:\1)+", r"\1", name) or "var"
        count[0] += 1
        self.variables.append((f"{name}{count[0] - 1}", self.whole[self.start[a] : self.start[b - 1] + len(self.text[b - 1])] if b > a else ""))
        return f"{{{name}{count[0] - 1}}}"

    def fill(self, args: list[tuple[int, int]], pattern: str, count: list[int]) -> str:
        rest = iter(args[1:])

        def next_one(m: re.Match) -> str:
            arg = next(rest, None)
            return m[0] if arg is None else self.fold(*arg, count)

        return re.sub(pattern, next_one, self.fold(*args[0], count))

    def template(self, args: list[tuple[int, int]]) -> str | None:
        self.variables = []
        while len(args) > 1 and not self.is_string(*args[0]):
            args = args[1:]
            if len(args) == 1 and not self.is_string(*args[0]):
                return None
        return self.fill(args, r"(?<!\\)\\\{\\\}", [0]) if args else None

    def target(self, dot: int, a: int) -> str:
        """The text of what stands before a dot."""
        starts = {e: s for s, e in self.end.items() if a <= s < dot}
        i = dot
        while i > a:
            i = starts.get(i - 1, i - 1)
            if self.kind[i] == "name" or self.text[i] == "new":
                if i == a or self.text[i - 1] != ".":
                    break
                i -= 1
            elif self.text[i] not in "([":
                break
        return "".join(self.text[i:dot])

    # ------------------------------------------------------------ structure

    def members(self, i: int, stop: int, name: str) -> None:
        while i < stop:
            e = self.find_member(i, stop)
            head = self.header(i, e)
            if e < stop and self.text[e] == "=":
                end = self.find(e, stop, ";")
                if "final" in head and "String" in head:
                    self.constants[head[-1]] = (e + 1, end)
                self.waiting.append((e + 1, end, name, "<init>", True))
                i = end + 1
            elif e < stop and self.text[e] == "{":
                end = self.end[e]
                kinds = [x for x in head if x in ("class", "interface", "enum", "record")]
                if kinds and "(" not in head[: head.index(kinds[0])] and head.index(kinds[0]) + 1 < len(head):
                    inner = head[head.index(kinds[0]) + 1]
                    self.members(e + 1, end, f"{name}${inner}" if name else ".".join(x for x in (self.package, inner) if x))
                else:
                    method = head[head.index("(") - 1] if "(" in head[1:] else "<init>"
                    self.waiting.append((e + 1, end, name, "<init>" if method == re.split(r"[.$]", name)[-1] else method, False))
                i = end + 1
            else:
                i = e + 1

    def find_member(self, i: int, stop: int) -> int:
        while i < stop and not (self.kind[i] == "sign" and self.text[i] in "{;="):
            i = self.end[i] + 1 if self.kind[i] == "sign" and self.text[i] in "([" else i + 1
        return min(i, stop)

    def header(self, i: int, e: int) -> list[str]:
        """A member's tokens without its annotations."""
        out = []
        while i < e:
            if self.text[i] == "@" and i + 1 < e and self.text[i + 1] != "interface":
                i += 2
                while i + 1 < e and self.text[i] == ".":
                    i += 2
                i = self.end[i] + 1 if i < e and self.text[i] == "(" else i
            else:
                out.append(self.text[i])
                i += 1
        return out

    def read(self) -> list[tuple[int, str, str, str, str, int | None]]:
        self.members(0, len(self.text), "")
        while self.waiting:
            a, b, name, method, expression = self.waiting.pop(0)
            Body(self, name, method).run(a, b, expression)
        order = sorted(range(len(self.calls)), key=lambda i: self.calls[i][0])
        place = {i: k for k, i in enumerate(order)}
        return [(*self.calls[i][1:6], place.get(self.calls[i][6])) for i in order]


class Body:
    """The control-flow graph of one body: vertex 0 enters it, every other is a statement, a condition or a log call."""

    def __init__(self, source: Source, name: str, method: str):
        self.s, self.name, self.method = source, name, method
        self.edges: dict[int, list[int]] = {}
        self.n, self.logs = 0, {}
        self.jumps: list[tuple[str | None, set[int], set[int] | None]] = []

    def run(self, a: int, b: int, expression: bool) -> None:
        s = self.s
        self.lines = (s.line[max(a - 1, 0)], s.line[min(b, len(s.line) - 1)]) if s.line else (1, 1)
        self.expression(a, b, {0}) if expression else self.block(a, b, {0})
        idom = immediate_dominators(self.edges, 0)
        for node, call in self.logs.items():
            up = idom.get(node)
            while up is not None and up not in self.logs:
                up = idom.get(up)
            self.s.calls[call] = (*self.s.calls[call][:6], self.logs.get(up))

    def node(self, before: set[int]) -> int:
        self.n += 1
        for x in before:
            self.edges.setdefault(x, []).append(self.n)
        return self.n

    def block(self, i: int, stop: int, before: set[int]) -> set[int]:
        while i < stop:
            i, before = self.statement(i, stop, before)
        return before

    def expression(self, a: int, b: int, before: set[int]) -> set[int]:
        s, at = self.s, self.node(before)
        found, i = [], a
        while i < b:
            x = s.text[i]
            if s.kind[i] == "sign" and x == "{" and i > a:
                if s.text[i - 1] == "->":
                    s.waiting.append((i + 1, s.end[i], self.name, self.method, False))
                    i = s.end[i]
                elif s.text[i - 1] == ")":
                    s.members(i + 1, s.end[i], f"{self.name}$1")
                    i = s.end[i]
            elif x == "(" and i - 2 > a and s.text[i - 2] == "." and s.kind[i - 1] == "name" and s.text[i - 1].upper() in LEVELS and "log" in s.target(i - 2, a).lower():
                template = s.template(s.split(i + 1, s.end[i], ","))
                if template is not None:
                    found.append((s.end[i], i, template, s.variables))
            i += 1
        for _, i, template, variables in sorted(found):  # inner calls run first
            at = self.node({at})
            self.logs[at] = len(s.calls)
            s.calls.append((i, s.line[i - 1], self.name, self.method, s.text[i - 1].upper(), template, None))
            s.details.append((variables, *self.lines))
        return {at}

    def jump(self, kind: str, label: str | None, before: set[int]) -> None:
        for names, ends, again in reversed(self.jumps):
            if (label in names if label else (kind == "break" and None in names) or (kind == "continue" and again is not None)):
                (ends if kind == "break" or again is None else again).update(before)
                return

    def statement(self, i: int, stop: int, before: set[int], labels: tuple = ()) -> tuple[int, set[int]]:
        s, x = self.s, self.s.text[i]
        if x == ";":
            return i + 1, before
        if x == "{":
            ends: set[int] = set()
            self.jumps.append((labels, ends, None))
            out = self.block(i + 1, s.end[i], before)
            self.jumps.pop()
            return s.end[i] + 1, out | ends
        if i + 1 < stop and s.kind[i] == "name" and s.text[i + 1] == ":" and x != "default":
            return self.statement(i + 2, stop, before, (*labels, x)) if i + 2 < stop else (stop, before)
        paren = i + 1 if i + 1 < stop and s.text[i + 1] == "(" else None
        if x == "if" and paren:
            test = self.expression(paren + 1, s.end[paren], before)
            i, out = self.next(s.end[paren] + 1, stop, test)
            if i < stop and s.text[i] == "else":
                i, other = self.next(i + 1, stop, test)
                return i, out | other
            return i, out | test
        if x in ("while", "for") and paren:
            parts = s.split(paren + 1, s.end[paren], ";") if x == "for" else [(paren + 1, s.end[paren])]
            if len(parts) > 1:
                before = self.expression(*parts[0], before)
            test = self.expression(*(parts[1] if len(parts) > 1 else parts[0] if parts else (paren, paren)), before)
            ends, again = set(), set()
            head = min(test) if len(test) == 1 else 0
            first = self.edges_into(test, before)
            self.jumps.append(((None, *labels), ends, again))
            i, out = self.next(s.end[paren] + 1, stop, test)
            self.jumps.pop()
            out = out | again
            if len(parts) > 2:
                out = self.expression(*parts[2], out) if out else out
            for y in out:
                self.edges.setdefault(y, []).append(first or head)
            return i, test | ends
        if x == "do":
            ends, again = set(), set()
            first = self.node(before)
            self.jumps.append(((None, *labels), ends, again))
            i, out = self.next(i + 1, stop, {first})
            self.jumps.pop()
            if i + 1 < stop and s.text[i] == "while" and s.text[i + 1] == "(":
                out = self.expression(i + 2, s.end[i + 1], out | again)
                for y in out:
                    self.edges.setdefault(y, []).append(first)
                i = s.find(s.end[i + 1], stop, ";") + 1
            return i, out | ends
        if x == "switch" and paren and s.end[paren] + 1 < stop:
            return self.switch(s.end[paren] + 1, self.expression(paren + 1, s.end[paren], before), labels)
        if x == "try":
            return self.attempt(i + 1, stop, before)
        if x == "synchronized" and paren:
            return self.next(s.end[paren] + 1, stop, self.expression(paren + 1, s.end[paren], before))
        if x == "class" or (x in ("final", "abstract", "static") and i + 1 < stop and s.text[i + 1] == "class"):
            body = s.find(i, stop, "{")
            s.members(i, min(stop, s.end.get(body, stop) + 1), f"{self.name}$1")
            return s.end.get(body, stop) + 1, before
        end = s.find(i, stop, ";")
        if x in ("break", "continue"):
            self.jump(x, s.text[i + 1] if i + 1 < end else None, before)
            return end + 1, set()
        out = self.expression(i, end, before)
        return end + 1, set() if x in ("return", "throw") else out

    def edges_into(self, test: set[int], before: set[int]) -> int:
        """The first vertex of a condition that was just entered from before."""
        return min((max(self.edges[x]) for x in before if x in self.edges), default=min(test))

    def next(self, i: int, stop: int, before: set[int]) -> tuple[int, set[int]]:
        return self.statement(i, stop, before) if i < stop else (stop, before)

    def switch(self, i: int, test: set[int], labels: tuple) -> tuple[int, set[int]]:
        s, stop, ends, out, done, falls = self.s, self.s.end.get(i, i), set(), set(), False, set()
        i += 1
        self.jumps.append(((None, *labels), ends, None))
        while i < stop:
            if s.text[i] in ("case", "default"):
                done |= s.text[i] == "default"
                i = s.find(i, stop, ":", "->")
                arrow = i < stop and s.text[i] == "->"
                falls = test if arrow else falls | test
                i += 1
                if arrow:
                    i, left = self.next(i, stop, falls)
                    out, falls = out | left, set()
            else:
                i, falls = self.statement(i, stop, falls)
        self.jumps.pop()
        return stop + 1, out | falls | ends | (set() if done else test)

    def attempt(self, i: int, stop: int, before: set[int]) -> tuple[int, set[int]]:
        """try: a handler may be entered from before the block and from each vertex in it, finally from all of these."""
        s = self.s
        start = self.node(before)
        out = {start}
        if i < stop and s.text[i] == "(":
            out, i = self.expression(i + 1, s.end[i], out), s.end[i] + 1
        i, out = self.next(i, stop, out)
        inside = set(range(start, self.n + 1))
        while i + 1 < stop and s.text[i] == "catch" and s.text[i + 1] == "(":
            i, left = self.next(s.end[i + 1] + 1, stop, inside)
            out = out | left
        if i < stop and s.text[i] == "finally":
            ends = bool(out)
            i, out = self.next(i + 1, stop, out | set(range(start, self.n + 1)))
            out = out if ends else set()
        return i, out


def report(text: str | None, names: frozenset[str] | None = None) -> Iterator[tuple[int, str]]:
    """(call, annotated body) of each log call whose dominators log variables that it does not.

    A comment above the call lists these variables, and a mark stands above each dominator in the same body; the body's
    least indentation is taken off.  names: only variables of these names.
    """
    source = Source(text or "")
    calls = source.read()
    order = sorted(range(len(source.calls)), key=lambda i: source.calls[i][0])
    lines = (text or "").split("\n")
    for k, (line, _, _, level, template, up) in enumerate(calls):
        own, first, last = source.details[order[k]]
        have, new, marks = {x for x, _ in own}, [], set()
        while up is not None:
            theirs = [(x, e) for x, e in source.details[order[up]][0] if x not in have and (names is None or x in names)]
            have |= {x for x, _ in theirs}
            new += theirs
            marks |= {calls[up][0]} if theirs else set()
            up = calls[up][5]
        if not new:
            continue
        out = []
        for at in range(first, last + 1):
            pad = re.match(r"\s*", lines[at - 1])[0]
            if at == line:
                quoted = template.replace("*/", "* /")
                out += [f"{pad}/* #LOG {level} {quoted}", *(f"{pad} * {x}: {e.replace('*/', '* /')}" for x, e in new), f"{pad} */"]
            if at in marks:
                out.append(f"{pad}// #LOG ASSOCIATE")
            out.append(lines[at - 1])
        least = min((len(x) - len(x.lstrip()) for x in out if x.strip()), default=0)
        yield k, "\n".join(x[least:] for x in out)


def injection_reports(sources: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(path, no, source): the annotated body of each call with something to inject.  names(name): a list of allowed
    variables, as from a file of one name a line; it goes to all tasks."""
    allowed = None if names is None else frozenset(r[0] for r in names.select("name").distinct().toLocalIterator())

    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, t in zip(f["path"], f["text"], strict=True) for r in report(t, allowed)], columns=["path", "no", "source"])

    return sources.select("path", "text").mapInPandas(kernel, "path string, no int, source string")


def read_file(path: str, text: str | None) -> Iterator[tuple]:
    source = Source(text or "")
    for no, (line, name, method, level, template, idom) in enumerate(source.read()):
        yield path, no, idom, source.package, name, method, line, level, template


def extract_statements(sources: DataFrame) -> DataFrame:
    """The statements table of sources(path, text): ids count calls by path and place; null and blank texts have none."""

    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for f in frames:
            rows = [r for p, t in zip(f["path"], f["text"], strict=True) for r in read_file(p, t)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"no": "Int32", "idom_no": "Int32", "line_number": "Int32"})

    # Every file is parsed once.  Files are numbered, one row for each, and not statements.
    found = stored(sources.select("path", "text").mapInPandas(kernel, FOUND), "found")
    files = running_totals(found.groupBy("path").agg(F.count("*").alias("n")), "path", "n")
    files = files.select(F.col("path").alias("file"), F.col("before").cast("int").alias("first"))
    rows = found.join(files, F.col("path").eqNullSafe(F.col("file")))
    return rows.select((F.col("idom_no") + F.col("first")).alias("idom_id"), (F.col("no") + F.col("first")).alias("event_id"), "path", "package", "class", "method", "line_number", "level", "template")
