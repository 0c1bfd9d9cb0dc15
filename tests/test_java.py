"""The Java front-end on small sources."""

import pytest

from logweave.__main__ import parser, run
from logweave.sources.java import extract_statements, injection_reports, literal, read_file, report


def found(body, extra=""):
    text = f"package a.b;\nclass T {{\n{extra}\nvoid run(Logger logger) {{\n{body}\n}}\n}}"
    return [(r[2], r[1], r[7], r[8]) for r in read_file("T.java", text)]


@pytest.mark.parametrize(
    "body, expected",
    [
        ('while(false){}\nlogger.info("sweet pineapple");', [(None, 0, "INFO", "sweet pineapple")]),
        ('logger.info("{}\\n{}",\n attribute,\n subject);', [(None, 0, "INFO", "{Attribute0}\\n{Subject1}")]),
        ('logger.info("first {}", ida); while (x()) { logger.info("second {}", idb); } logger.info("third {}", idc);',
         [(None, 0, "INFO", "first {Ida0}"), (0, 1, "INFO", "second {Idb0}"), (0, 2, "INFO", "third {Idc0}")]),
        ('if (a) logger.warn("x"); else { logger.error("y"); } logger.debug("z");', [(None, 0, "WARN", "x"), (None, 1, "ERROR", "y"), (None, 2, "DEBUG", "z")]),
        ('log.info("a"); if (b) return; log.info("b"); try { log.info("c"); } catch (E e) { log.error("d", e); } finally { log.info("e"); }',
         [(None, 0, "INFO", "a"), (0, 1, "INFO", "b"), (1, 2, "INFO", "c"), (1, 3, "ERROR", "d"), (1, 4, "INFO", "e")]),
        ('do { log.info("a"); if (x) continue; log.info("b"); } while (y); log.info("c");', [(None, 0, "INFO", "a"), (0, 1, "INFO", "b"), (0, 2, "INFO", "c")]),
        ('switch (x) { case 1: log.info("a"); break; case 2: log.info("b"); default: log.info("c"); } log.info("d");',
         [(None, 0, "INFO", "a"), (None, 1, "INFO", "b"), (None, 2, "INFO", "c"), (None, 3, "INFO", "d")]),
        ('for (int i = 0; i < n; i++) { log.info("a"); if (q) break; } log.info("b");', [(None, 0, "INFO", "a"), (None, 1, "INFO", "b")]),
        ('log.info("a"); run(() -> { log.info("in"); }); log.info("b");', [(None, 0, "INFO", "a"), (None, 1, "INFO", "in"), (0, 2, "INFO", "b")]),
        ('log.info("a " + user.getName() + " {b}");', [(None, 0, "INFO", "a {UserName0} \\{b\\}")]),
        ('log.info(marker, "m {} {}", x);', [(None, 0, "INFO", "m {X0} \\{\\}")]),
        ('log.info("m {}", x, y); log.info("n".concat(z)); log.info(PRE + 1); log.info(null);',
         [(None, 0, "INFO", "m {X0}"), (0, 1, "INFO", "n{Z0}"), (1, 2, "INFO", "pre {var0}"), (2, 3, "INFO", "null")]),
        ('log.info(String.format("%s is %d", a, b));', [(None, 0, "INFO", "{A0} is {B1}")]),
        ('info("x"); other.info("x"); log.info(); log.warning("x"); catalog.info("y"); // log.info("no")', [(None, 0, "INFO", "y")]),
    ],
)
def test_calls(body, expected):
    assert found(body, 'static final String PRE = "pre ";') == expected


def test_names_and_damage():
    text = 'package p;\npublic class A {\n A() { log.info("i"); }\n static class B { @X("{") void m() { this.log.info("j"); } }\n static { log.info("k"); }\n}'
    assert [(r[3], r[4], r[5], r[6], r[8]) for r in read_file("A.java", text)] == [("p", "p.A", "<init>", 3, "i"), ("p", "p.A$B", "m", 4, "j"), ("p", "p.A", "<init>", 5, "k")]
    for n in range(len(text)):  # cut anywhere, the rest is read
        list(read_file("A.java", text[:n]))
        list(read_file("A.java", text[n:]))
    assert literal(r'"a\"\u0041\101\n"') == 'a"AA\n'
    assert literal('"""\n  a\n   b\n  """') == "a\n b\n"
    assert list(read_file("x", None)) == []


def test_table(spark):
    a, b = 'class A { void m() { log.info("x"); log.info("y"); } }', 'class B { void m() { log.info("z {}", q); log.info("w"); } }'
    rows = extract_statements(spark.createDataFrame([("b", b), ("a", a), ("c", None), ("d", "")], "path string, text string")).orderBy("event_id").collect()
    assert [(r["idom_id"], r["event_id"], r["path"], r["template"]) for r in rows] == [(None, 0, "a", "x"), (0, 1, "a", "y"), (None, 2, "b", "z {Q0}"), (2, 3, "b", "w")]


def test_reports(spark):
    text = 'class A {\n  void m() {\n    log.info("user {}", u.id());\n    if (x) {\n      log.warn("bad {}", why);\n    }\n  }\n}'
    wanted = 'void m() {\n  // #LOG ASSOCIATE\n  log.info("user {}", u.id());\n  if (x) {\n    /* #LOG WARN bad {Why0}\n     * UId0: u.id()\n     */\n    log.warn("bad {}", why);\n  }\n}'
    assert list(report(text)) == [(1, wanted)]
    assert list(report(text, frozenset(["Other0"]))) == [] == list(report(None))
    sources = spark.createDataFrame([("a", text), ("b", None)], "path string, text string")
    assert [tuple(r) for r in injection_reports(sources).collect()] == [("a", 1, wanted)]
    names = spark.createDataFrame([("UId0",)], "name string")
    assert injection_reports(sources, names).count() == 1


def test_command_line(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text('class A {\n void m() {\n  log.info("user {}", userId);\n  log.info("done");\n }\n}')
    (tmp_path / "x-output.txt").write_text("".join(f"2024-01-01 00:00:0{i},00{k} INFO [main] p.A (A.java:m({3 + k})) - t\n" for i in range(5) for k in (0, 1)))
    call = lambda *a: run(spark, parser().parse_args([*map(str, a)]))
    env = ("-e", f"file:{tmp_path / 'src'}")
    call(*env, "output", tmp_path / "graph")
    assert call("stats", tmp_path / "graph") == {"stmt_count": 2, "stmt_w_id_count": 1, "stmt_w_injection_count": 1}
    assert call("compare", tmp_path / "graph", tmp_path, "--min_support", 5) == {"matching_paths_count": 1}
    assert call("compare", tmp_path / "graph", tmp_path) == {"matching_paths_count": 0}
    call(*env, "injections", tmp_path / "reports")
    assert "#LOG INFO done" in spark.read.option("multiLine", True).option("escape", '"').csv(str(tmp_path / "reports")).first()[0]
