"""Operators on small cases, against plain Python."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions import text as t
from logweave.operators import diff, graph, logs, sequences
from logweave.operators.dominators import immediate_dominators
from logweave.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("name, expected", [("UserId0", True), ("Path2", True), ("hostname", True), ("Url", True), ("Ship1", True), ("Valid0", True), ("userID0", False), ("Ida0", False), ("var0", False), ("", False)])
def test_is_id(spark, name, expected):
    assert one(spark, t.is_id(F.lit(name))) is expected
    words = re.findall("[a-zA-Z][a-z]*", name)
    endings = ("id", "path", "address", "host", "ip", "name", "url", "uri")
    assert any(w.lower().endswith(endings) for w in words) is expected


def test_names_and_placeholders(spark):
    for name, expected in {"getUserName": "UserName", "user_id": "UserId", "getter": "Ter", "get": "", "fooFoo barbar": "FooBarbar"}.items():
        assert one(spark, t.normalise_name(F.lit(name))) == expected, name
    assert one(spark, t.variables(F.lit(r"a {X0} \{y\} {var1}"))) == ["X0", "var1"]
    assert one(spark, t.escape(F.lit("a{b}\nc"))) == r"a\{b\}\nc"
    assert one(spark, t.placeholder_names(F.array(F.lit("User"), F.lit("")))) == ["{User0}", "{var1}"]
    fill = lambda s, *a, p=t.SLF4J: one(spark, t.fill_placeholders(F.lit(s), F.array(*map(F.lit, a)), p))
    assert fill("{} and {}", "1") == "1 and {}"
    assert fill("{}", "1", "2") == "1"
    assert fill("%s, %d", "1", "2", p=t.PRINTF) == "1 2"


def test_log_lines(spark, tmp_path):
    lines = ["2024-01-01 00:00:01,123 INFO  [main] pkg.Cls (Foo.java:bar(42)) - text", "2024-13-01 00:00:01,123 INFO  [m] p (Foo.java:bar(42)) - x", "2024-01-01 00:00:01,1 INFO  [m] p (Foo.java:bar(7)) - x", "no match"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x-output.txt").write_text("\r\n".join(lines) + "\n")
    (tmp_path / "a" / "other.txt").write_text("no log")
    rows = logs.parse_log_lines(tables.scan_logs(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [(r["line_no"], r["file_name"], r["line_number"], r["ts"].microsecond) for r in rows] == [(0, "Foo.java", 42, 123000), (2, "Foo.java", 7, 100000)]


def test_environment():
    assert tables.parse_environment("file:a;b") == ("file", ["a", "b"])
    assert tables.parse_environment("maven:x") == ("maven", ["x"])
    for bad in ("nothing", "http:x"):
        with pytest.raises(ValueError):
            tables.parse_environment(bad)


FOREST = [(1, None, "{UserId0}"), (2, 1, "{Count0}"), (3, 2, "{Host0} {UserId1}"), (4, None, "plain"), (5, 99, "{Ip0}"), (6, 1, "{UserId0}")]


def forest(spark):
    return spark.createDataFrame(FOREST, "event_id int, idom_id int, template string")


def test_graph(spark):
    s = forest(spark)
    ids = lambda df: sorted(r["event_id"] for r in df.collect())
    assert ids(graph.roots(s)) == [1, 4]
    assert ids(graph.leaves(s)) == [3, 4, 5, 6]
    assert sorted(map(tuple, graph.dominator_chain(s).collect())) == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (5, 99, 1), (6, 1, 1)]
    assert {r[0]: r[1] for r in graph.paths(s).collect()} == {3: [1, 2, 3], 4: [4], 5: [99, 5], 6: [1, 6]}
    assert tuple(graph.statement_stats(s).first()) == (6, 4, 3, 3)
    assert {r[0]: r[1] for r in graph.injected_variables(s).collect()} == {2: ["UserId0"], 3: ["Count0", "UserId0"]}
    only = spark.createDataFrame([("Count0",)], "name string")
    assert {r[0]: r[1] for r in graph.injected_variables(s, only).collect()} == {3: ["Count0"]}
    assert graph.dominator_chain(s.limit(0)).count() == 0


def test_rolling_sequences(spark):
    times = [0, 5, 5, 5, 16, 20, 21, 40]
    rows = spark.createDataFrame([("f", u, i, str(i)) for i, u in enumerate(times)], "stream string, us long, seq long, item string")
    got = {r["seq"] - 1: "".join(r["items"]) for r in sequences.rolling_sequences(rows, window_us=16, shortest=1).collect()}
    assert [got[i] for i in range(8)] == ["0", "01", "012", "0123", "1234", "12345", "456", "7"]


def test_patterns_and_paths(spark):
    rows = [[1, 2, 3], [1, 3], [1, 2], [2, 3], [1, 2, 3, 1], [3]]
    df = spark.createDataFrame([(r,) for r in rows], "items array<int>")
    inside = lambda p, s: all(x in it for it in [iter(s)] for x in p)
    for support, n in ((1, 14), (2, 7), (3, 6), (4, 3)):
        found = {tuple(r[0]): r[1] for r in sequences.frequent_patterns(df, support=support).collect()}
        assert len(found) == n
        assert all(v == sum(inside(p, s) for s in rows) for p, v in found.items())
    wanted = [list(p) for p in itertools.product((1, 2, 3), repeat=2)]
    paths = spark.createDataFrame([(p,) for p in wanted], "path array<int>")
    got = {tuple(r[0]): r[1] for r in sequences.path_support(df, paths, support=2).collect()}
    assert got == {tuple(p): n for p in wanted if (n := sum(inside(p, s) for s in rows)) >= 2}


def test_template_match(spark):
    messages = spark.createDataFrame([(1, "first 42"), (2, "a {b} 7"), (3, ""), (4, "other")], "id int, message string")
    kinds = spark.createDataFrame([(0, "first {Ida0}"), (1, "{Any0}"), (2, r"a \{b\} {N0}")], "template_id int, template string")
    got = {r["id"]: (r["template_id"], r["values"], round(r["score"], 2)) for r in logs.template_match(messages, kinds).collect()}
    assert got == {1: (0, ["42"], 0.75), 2: (2, ["7"], 0.86), 4: (1, ["other"], 0.0)}


def test_diff(spark):
    lines = [(" ", "x();"), ("-", "log.info(a,"), ("-", "b);"), (" ", "log.error(userId);"), ("+", "LOG.warning("), (" ", "name);"), ("+", "open(")]
    rows = spark.createDataFrame([(1, 0, i, o, c) for i, (o, c) in enumerate(lines)], "commit int, hunk int, line_no int, origin string, content string")
    calls = diff.diff_log_calls(diff.diff_spans(rows))
    got = sorted((r["side"], r["callee"], r["kind"], r["has_id"]) for r in calls.collect())
    assert got == [("+", "LOG.warning", "~", True), ("-", "log.info", "-", False)]
    commits = spark.createDataFrame([(1,), (2,)], "commit int")
    assert sorted(map(tuple, diff.diff_track(commits, calls).collect())) == [(1, 1, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_dominators(pairs):
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, []).append(b)

    def reach(without=None):
        seen, todo = set(), [0] if without != 0 else []
        while todo:
            x = todo.pop()
            if x not in seen and x != without:
                seen.add(x)
                todo += edges.get(x, [])
        return seen

    idom = immediate_dominators(edges, 0)
    nodes = reach()
    assert set(idom) == nodes - {0}
    for x in idom:
        doms = {d for d in nodes if d != x and (d == 0 or x not in reach(d))}
        up, chain = x, set()
        while up in idom:
            up = idom[up]
            chain.add(up)
        assert chain == doms


def test_lookback(spark):
    rnd = random.Random(3)
    kinds = ["a", "b", "c", "d"]
    parents = {"c": "b", "b": "a"}
    rows = [("s", i, rnd.choice(kinds), str(i)) for i in range(60)]

    def values(i):
        out, todo = {rows[i][3]}, [i]
        while todo:
            k = todo.pop()
            for j in range(max(0, k - 10), k):
                if rows[j][2] == parents.get(rows[k][2]):
                    out.add(rows[j][3])
                    todo.append(j)
        return sorted(out)

    df = spark.createDataFrame(rows, "stream string, seq long, type string, value string")
    assert {r[1]: r[2] for r in logs.lookback_values(df, parents).collect()} == {i: values(i) for i in range(60)}
