r"""Chat formatting with a grammar round trip.

    conversation := "<s>" turn*
    turn         := "<<SYS>>\n" text "\n<</SYS>>\n"             system
                  | "[INST] " text " [/INST]"                   user
                  | " " text " </s>"                            assistant
                  | "[ROLE=" name "] " text " [/ROLE]"          any other role, its name percent-encoded

A control string inside a text has an odd number of backslashes before it, one of the grammar none; 2 n + 1 stand for n.
Each turn is rendered as it is and parsed again; if that does not give back its role and text, its control strings are
escaped, until it does.  Rendered turns are rows, so that a conversation of any length needs the memory of one turn;
the reader parses their concatenation and knows nothing of the rows' borders.

Turns come in order of turn, then role, then text, nulls first, so ties and repeated rows have a defined order.  Null
text is empty, a null role is the empty name, and rows of null conv_id are one conversation.  A text of any length takes
time in proportion; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common as c

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]"]
START = "<s>"
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_OTHER = re.compile(r"\[ROLE=([A-Za-z0-9_.~%-]*)\] ")
#: The beginning of a mark that opens a turn.
_PART = re.compile(r"\[(?:I(?:N(?:S(?:T\]?)?)?)?)?|<(?:<(?:S(?:Y(?:S(?:>>?)?)?)?)?)?|\[(?:R(?:O(?:L(?:E(?:=[A-Za-z0-9_.~%-]*\]?)?)?)?)?)?")


class Conflict(ValueError):
    """The text is not of the grammar."""


def controls(text: str, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """(where the backslashes before it begin, where it begins, where it ends) of every control string from `at` on."""
    for m in _CONTROL.finditer(text, at):
        first = m.start()
        while first > at and text[first - 1] == "\\":
            first -= 1
        at = m.end()
        yield first, m.start(), at


def escape(text: str) -> str:
    out, done = [], 0
    for first, begin, end in controls(text):
        out.append(text[done:begin] + text[first:begin] + "\\" + text[begin:end])
        done = end
    return "".join(out) + text[done:]


def unescape(text: str) -> str:
    out, done = [], 0
    for first, begin, end in controls(text):
        if (begin - first) % 2 == 0:
            raise Conflict(text[begin:end])
        out.append(text[done : first + (begin - first) // 2] + text[begin:end])
        done = end
    return "".join(out) + text[done:]


def parse_turn(text: str, at: int) -> tuple[str, str, int, int, int] | None:
    """(role, text, where its escaped text begins and ends, end) of the turn at `at`; None if it has not ended."""
    for role, (opening, closing) in MARKS.items():
        if text.startswith(opening, at):
            break
    else:
        if not (m := _OTHER.match(text, at)):
            raise Conflict(text[at : at + 40])
        role, opening, closing = unquote(m[1]), m[0], " [/ROLE]"
    begin = at + len(opening)
    mark = closing.strip()
    for first, here, past in controls(text, begin):
        if first < here:
            continue
        end = here - (len(closing) - len(closing.lstrip()))
        if text[here:past] == mark and past == len(text) and len(text) - end < len(closing):
            return None  # its last line end is still to come
        if text[here:past] != mark or end < begin or not text.startswith(closing, end):
            raise Conflict(text[here:past])
        return role, unescape(text[begin:end]), begin, end, end + len(closing)
    return None


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the grammar, and where its text begins and ends."""
    opening, closing = MARKS.get(role) or (f"[ROLE={quote(role, safe='')}] ", " [/ROLE]")
    body = text
    for _ in range(2):
        out = opening + body + closing
        try:
            turn = parse_turn(out, 0)
            if turn and turn[:2] == (role, text) and turn[4] == len(out):
                return out, turn[2], turn[3]
        except Conflict:
            pass
        body = escape(text)
    raise Conflict(f"no rendering of {role!r} turn {text[:80]!r}")


class Parser:
    """Parses a conversation that arrives in pieces of any size."""

    def __init__(self) -> None:
        self.rest, self.started = "", False

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        at = 0
        if not self.started:
            if len(self.rest) < len(START):
                return
            if not self.rest.startswith(START):
                raise Conflict(self.rest[:40])
            at, self.started = len(START), True
        while at < len(self.rest) and not _PART.fullmatch(self.rest, at) and (turn := parse_turn(self.rest, at)):
            yield turn[:2]
            at = turn[4]
        self.rest = self.rest[at:]


TURNS = "conv_id long, place long, formatted string, loss_start long, loss_end long"


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, place = object(), 0
    for b in batches:
        rows = []
        for conv, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            role = role or ""
            place = place + 1 if conv == last else 0
            last = conv
            out, begin, end = render(role, text or "")
            head = "" if place else START
            mine = role == "assistant"
            rows.append((conv, place, head + out, begin + len(head) if mine else None, end + len(head) if mine else None))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["conv_id", "place", "formatted", "loss_start", "loss_end"])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None
    done: list[tuple] = []

    def end() -> None:
        if state[1].rest:
            raise Conflict(f"conversation {state[0]} does not end: {state[1].rest[:40]!r}")
        done.append((state[0], state[2], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6]))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    for b in batches:
        for conv, place, text, begin, stop in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if place == 0:
                if state:
                    end()
                state = [conv, Parser(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[6] += len(text)
            for role, said in state[1].feed(text):
                state[2] += 1
                state[3].update(f"{role}\n{said}\n".encode())
            if begin is not None:
                loss = unescape(text[begin:stop])
                state[4] += len(loss)
                state[5].update(loss.encode())
        yield batch()
    if state:
        end()
    yield batch()


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, formatted, loss_start, loss_end) of every row of conversations(conv_id, turn, role, text).

    A conversation's formatted text is its rows' formatted text by place, from 0; its rows stay together and in order.
    The loss mask, in code points of the row, covers an assistant's text as it is escaped.
    """
    spark = c.prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition(c.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return c.map_arrow(rows.select("conv_id", "role", "text"), _format, TURNS)


def read_back(turns: DataFrame) -> DataFrame:
    """What the parser finds in format_turns' output, by conversation; rows may come in any order, as from a table."""
    spark = c.prepare(turns.sparkSession)
    rows = turns.repartition(c.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "place")
    return c.map_arrow(rows.select(*[x.split()[0] for x in TURNS.split(", ")]), _read_back, DIGEST)


_ESCAPED = r"regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[ROLE=|\[/ROLE\])', '\1\1\\\2', 'g')"
SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), rendered AS (
  SELECT *, length({_ESCAPED}) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 16 + length(url_encode(role)) END AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
"""
