"""Git histories, the template parser, projects and sources, and operators on repeated and unlike rows."""

import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from logweave.__main__ import parser, run
from logweave.functions import edits
from logweave.operators import diff, graph, logs, sequences, templates
from logweave.sources import git, tables

JAVA = 'class A {\n  void run(int userId) {\n    log.info("start {}", userId);\n    int a = 1;\n%s  }\n}\n'


def in_repo(at, *args, **env):
    who = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(at), *args], env=os.environ | who | env, check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    """Three commits: a call appears, is revised, and goes; beside it a text file and a binary one change."""
    at = tmp_path_factory.mktemp("git") / "subject"
    at.mkdir()
    in_repo(at, "init", "-q")
    steps = [("", b"\0\1"), ('    log.error("late " + hostName);\n', b"\0\2"), ('    log.error("late " + count);\n', b"\0\3"), ("", b"\0\4")]
    ids = []
    for k, (extra, data) in enumerate(steps):
        (at / "A.java").write_text(JAVA % extra)
        (at / "notes.txt").write_text(f"log.info(x{k})\n")
        (at / "b.java").write_bytes(data)
        in_repo(at, "add", "-A")
        in_repo(at, "commit", "-q", "-m", f"step {k}", GIT_AUTHOR_DATE=f"{1_700_000_000 + k} +0000", GIT_COMMITTER_DATE=f"{1_700_000_000 + k} +0000")
        ids.append(in_repo(at, "rev-parse", "HEAD"))
    return str(at), ids


def test_commits_and_tracking(spark, history, tmp_path):
    at, ids = history
    commits = git.read_commits(spark.createDataFrame([(at,)], "repository string"))
    assert [(r["commit"], r["timestamp"], r["parents"]) for r in commits.orderBy("walk_order").collect()] == [(x, 1_700_000_000 + k, ids[k - 1 : k]) for k, x in enumerate(ids)]
    lines = git.read_hunk_lines(commits)
    assert {(r["path"], r["is_binary"]) for r in lines.collect()} == {("A.java", False), ("notes.txt", False), ("b.java", True)}
    assert {r["path"] for r in diff.java_lines(lines).collect()} == {"A.java"}
    # The commit's own lines are -, those of its parent +.
    added = lines.where(F.col("commit") == ids[1]).where("path = 'A.java' and origin <> ' '").collect()
    assert [(r["origin"], r["content"]) for r in added] == [("-", '    log.error("late " + hostName);')]
    run(spark, parser().parse_args(["track", at, str(tmp_path / "out")]))
    got = {r["commit"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    counts = [tuple(int(got[x][n]) for n in ("parents", "numold", "numoldid", "numnew", "numnewid", "numrev", "numrevid")) for x in ids]
    assert counts == [(0, 0, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0), (1, 1, 0, 1, 1, 0, 0), (1, 0, 0, 1, 0, 0, 0)]


def test_diff_lines():
    text = "diff --git a/x/A.java b/x/A.java\nindex 1..2 100644\n--- a/x/A.java\n+++ b/x/A.java\n@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+c\n\\ No newline at end of file\n@@ -9 +9,0 @@ x\n--- d\ndiff --git a/B.java b/B.java\ndeleted file mode 100644\n--- a/B.java\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\ndiff --git a/c.bin b/c.bin\nBinary files a/c.bin and b/c.bin differ\n"
    assert list(git.parse_diff(text)) == [
        ("x/A.java", False, 0, 0, " ", "a"), ("x/A.java", False, 0, 1, "-", "b"), ("x/A.java", False, 0, 2, ">", "\\ No newline at end of file"),
        ("x/A.java", False, 0, 3, "+", "c"), ("x/A.java", False, 0, 4, "<", "\\ No newline at end of file"), ("x/A.java", False, 1, 0, "-", "-- d"),
        ("B.java", False, 0, 0, "-", "z"), ("c.bin", True, 0, 0, "B", "Binary files a/c.bin and b/c.bin differ"),
    ]


def test_clones_and_failures(spark, history, tmp_path):
    at, ids = history
    subjects = spark.createDataFrame([(at, ids[1]), (at + "-none", "HEAD")], "url string, commit string")
    got = {r["url"]: r for r in git.clone(subjects, str(tmp_path)).collect()}
    assert got[at]["error"] is None and in_repo(got[at]["repository"], "rev-parse", "HEAD") == ids[1]
    assert got[at + "-none"]["error"]


def test_calls_in_literals_are_none(spark):
    texts = ['x = "log.info(y)"; this.log.warn(z);', "a.logger.info(hostName)", 'log.error("userId", n);', "catalog.dialog.debug( /* id */ n)", "b.log.info(n)", "log.info( ); log.trace(log.info(k))"]
    rows = [(k, 0, "-", k, "-", x) for k, x in enumerate(texts)]
    spans = spark.createDataFrame(rows, "commit int, hunk int, side string, span int, changes string, text string")
    got = sorted((r["commit"], r["callee"], r["has_id"]) for r in diff.diff_log_calls(spans).collect())
    assert got == [(2, "log.error", False), (3, "catalog.dialog.debug", False), (5, "log.info", False), (5, "log.trace", False)]


# ---------------------------------------------------------------- templates


def test_repeated_messages_match_each(spark):
    kinds = spark.createDataFrame([(3, "a {X0}"), (1, "{Y0} b"), (2, "{Z0}")], "template_id int, template string")
    rows = spark.createDataFrame([(x,) for x in ["a b", "a b", "a b", "q b", "", None]], "message string")
    got = sorted((r["message"], r["template_id"], r["values"]) for r in logs.template_match(rows, kinds).collect())
    assert got == [("a b", 3, ["b"])] * 3 + [("q b", 1, ["q "])]
    two = sorted((r["message"], r["template_id"]) for r in logs.template_match(rows, kinds, top=2).collect())
    assert two == [("a b", 1)] * 3 + [("a b", 3)] * 3 + [("q b", 1), ("q b", 2)]
    assert logs.template_match(rows, kinds.limit(0)).count() == 0


def test_template_commands(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"","0","A.java","INFO","open {FileName0} "\n"0","1","A.java","INFO","read {Size0} of <Mode1>"\n"1","2","A.java","WARN","slow {Ms0}"\n')
    (tmp_path / "x.log").write_text("1 open a.txt\n1 read 7 of <Mode1>\n1 slow 30\n1 what\n1 slow 9\n")
    run(spark, parser().parse_args(["parse", str(tmp_path / "t.csv"), str(tmp_path / "x.log"), str(tmp_path / "parsed"), "-f", r"^\d+ (.*)$"]))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "parsed")).collect()] == [{"0": ["a.txt"]}, {"1": ["7 ", "a.txt"]}, {"2": ["30", "7 ", "a.txt"]}, {"2": ["7 ", "9", "a.txt"]}]
    run(spark, parser().parse_args(["stat", str(tmp_path / "t.csv"), str(tmp_path / "stat")]))
    got = sorted(spark.read.option("escape", '"').csv(str(tmp_path / "stat")).collect(), key=lambda r: r[1])
    assert [tuple(r) for r in got] == [(None, "0", "['FileName0']", "[]"), ("0", "1", "['Size0']", "['FileName0']"), ("1", "2", "['Ms0']", "['Size0', 'FileName0']")]
    run(spark, parser().parse_args(["stat", str(tmp_path / "t.csv"), str(tmp_path / "stat2"), "-p", r"<(\w+)>"]))
    assert {r[2] for r in spark.read.option("escape", '"').csv(str(tmp_path / "stat2")).collect()} == {"[]", "['Mode1']"}


def test_templates_that_are_missing(spark):
    kinds = spark.createDataFrame([(1, "p", "INFO", "t")], "template_id int, path string, level string, template string")
    assert graph.with_template(spark.createDataFrame([(1,)], "template_id int"), kinds).first()["level"] == "INFO"
    with pytest.raises(Exception, match="no template 2"):
        graph.with_template(spark.createDataFrame([(2,)], "template_id int"), kinds).collect()


# ---------------------------------------------------------------- projects and sources


def test_projects_have_results_of_their_own(spark, tmp_path):
    for name, body in (("one", '    log.warn("b " + a);\n'), ("two", "")):
        folder = tmp_path / name / "src"
        folder.mkdir(parents=True)
        (folder / "A.java").write_text(JAVA % body)
        (tmp_path / name / "run-output.txt").write_text("".join(f"2024-01-01 00:00:0{s},000 INFO  [main] x.Y (A.java:run({n})) - m\n" for s in range(4) for n in (3, 5)))
    (tmp_path / "broken").mkdir()
    at = ["projects", "graph", str(tmp_path)]
    assert [x.split(":")[0] for x in run(spark, parser().parse_args(at)).values()][1:] == ["done", "done"]
    assert list(run(spark, parser().parse_args(["projects", "stats", str(tmp_path)])).values())[1:] == ["done", "done"]
    assert list(run(spark, parser().parse_args(["projects", "compare", str(tmp_path), "--min_support", "4"])).values())[1:] == ["done", "done"]
    read = lambda name, x: json.loads((tmp_path / name / "target" / x).read_text())
    assert read("one", "statement_counts.json") == {"stmt_count": 2, "stmt_w_id_count": 1, "stmt_w_injection_count": 1}
    assert read("two", "statement_counts.json") == {"stmt_count": 1, "stmt_w_id_count": 1, "stmt_w_injection_count": 0}
    assert read("one", "matching_paths.json") == {"matching_paths_count": 1} and read("two", "matching_paths.json") == {"matching_paths_count": 0}


def test_modules_of_a_project(spark, tmp_path):
    for folder, pom in (("", "<modules><module>core</module><module>none</module></modules>"), ("core", "<build><sourceDirectory>code</sourceDirectory></build>")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "pom.xml").write_text(f'<project xmlns="http://maven.apache.org/POM/4.0.0">{pom}</project>')
    for path in ("src/main/java/A.java", "src/test/java/T.java", "core/code/B.java", "other/src/main/java/C.java"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("class X {}")
    assert sorted(os.path.basename(r["path"]) for r in tables.scan_source(spark, f"maven:{tmp_path}").collect()) == ["A.java", "B.java"]
    assert tables.scan_source(spark, f"maven:{tmp_path}/none").count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    text = [f"line {i}" if i % 7 else "" for i in range(5000)]
    (tmp_path / "a-output.txt").write_text("\r\n".join(text))
    (tmp_path / "b-output.txt").write_text("only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {(os.path.basename(r["file"]), r["line_no"]): r["line"] for r in tables.scan_logs(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a-output.txt", i): x for i, x in enumerate(text) if x} | {("b-output.txt", 0): "only"}


def test_running_totals(spark):
    rows = [(f"k{i:05d}", i % 11) for i in range(3000)]
    got = dict(map(tuple, tables.running_totals(spark.createDataFrame(rows, "k string, n long").repartition(7), "k", "n").collect()))
    total = 0
    for k, n in sorted(rows):
        assert got[k] == total
        total += n


# ---------------------------------------------------------------- graphs and sequences


def test_idoms_in_a_circle(spark):
    rows = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    with pytest.raises(ValueError, match="cycle"):
        graph.dominator_chain(spark.createDataFrame(rows, "event_id int, idom_id int"))


@pytest.mark.parametrize("block", [0, 7, 40])
def test_rolling_over_blocks(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(-200, 200), k, rnd.randrange(9)) for k in range(500)]
    want = []
    for s in ("a", "b", None):
        mine = sorted((r[1:] for r in rows if r[0] == s), key=lambda r: r[:2])
        for i, (us, _, _) in enumerate(mine):
            held = [x for t, _, x in mine[: i + 1] if t > us - 7][:5]
            if len(held) >= 2 and i < 100:
                want.append((str(s), i + 1, held))
    events = spark.createDataFrame(rows, "stream string, us long, seq long, item int")
    got = sequences.rolling_sequences(events, window_us=7, longest=5, limit=100, block_us=block)
    assert sorted((str(r["stream"]), r["seq"], r["items"]) for r in got.collect()) == sorted(want)


def test_formats(spark):
    form = logs.t.LogFormat(r"^(\d+) (\w+):(\d+)$", lambda x: F.timestamp_seconds(x.try_cast("long")).cast("timestamp_ntz"))
    rows = spark.createDataFrame([("60 A:7",), ("x A:7",), ("60 A:99999999999",), (None,)], "line string")
    assert [(str(r["ts"]), r["file_name"], r["line_number"]) for r in logs.parse_log_lines(rows, form=form).collect()] == [("1970-01-01 00:01:00", "A", 7)]
    assert templates._groups(r"(a)\((?:b)[(](?<c>d)(?=e)") == 2


def test_edits(spark):
    text = "  ab\n\t cd\n"
    one = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    got = one.select(edits.within(t, 2, 4), edits.within(t, 3, 99), edits.insert(t, 4, F.lit("!")), edits.delete(t, 0, 2), edits.block_start(t, F.lit(7)), edits.deindent(F.lit("  a\n    b\n\n  c"))).first()
    assert tuple(got) == ("ab", None, "  ab!\n\t cd\n", "ab\n\t cd\n", 5, "a\n  b\n\nc")
