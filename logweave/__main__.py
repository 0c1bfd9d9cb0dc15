"""python -m logweave: log statements, injections, statistics, path support, log parsing and changes, from the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import text as t
from logweave.operators import diff, graph, logs, sequences, templates
from logweave.sources import git, java, tables

#: Where a project keeps its graph, and the results that are written beside it.
GRAPH, RESULTS = "target/log_graph", {"stats": "target/statement_counts.json", "compare": "target/matching_paths.json"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logweave", description=__doc__)
    p.add_argument("-e", "--env", "--environment", dest="environment", default="file:.", help="file:path;path or maven:folder")
    p.add_argument("-v", "--verbose", action="count", default=0, help="tell what is done")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("output", help="write the statements as CSV").add_argument("out")
    injections = sub.add_parser("injections", help="write annotated bodies as CSV")
    injections.add_argument("-x", "--ids", help="file of allowed variables, one a line")
    injections.add_argument("out")
    stats = sub.add_parser("stats", help="counts of statements, as JSON")
    stats.add_argument("statements", help="CSV of statements")
    stats.add_argument("-o", "--output", help="file; printed if there is none")
    compare = sub.add_parser("compare", help="how many dominator paths are frequent in logs, as JSON")
    compare.add_argument("statements", help="CSV of statements")
    compare.add_argument("logs", help="folder of logs")
    compare.add_argument("-o", "--output", help="file; printed if there is none")
    projects = sub.add_parser("projects", help="one command for every folder below a root, each with results of its own")
    projects.add_argument("what", choices=["graph", "stats", "compare"])
    projects.add_argument("root")
    projects.add_argument("--launcher", choices=["file", "maven"], default="file")
    for x in (compare, projects):
        for name, kind, value in (("max_dataset_size", int, -1), ("min_sequence_length", int, 2), ("max_sequence_length", int, 16), ("window_size_ms", int, 16), ("min_support", int, 16), ("max_distance", float, 0.0)):
            x.add_argument(f"--{name}", type=kind, default=value)
    parse = sub.add_parser("parse", help="log lines to templates and values, as JSON lines")
    parse.add_argument("templates", help="CSV of templates")
    parse.add_argument("logs", help="folder or file of logs")
    parse.add_argument("out")
    parse.add_argument("-f", "--format", default=templates.FORMAT, help="a record's pattern; its groups are the message")
    stat = sub.add_parser("stat", help="variables of templates and of their dominators, as CSV")
    stat.add_argument("templates", help="CSV of templates")
    stat.add_argument("out")
    for x in (parse, stat):
        x.add_argument("-p", "--variable-pattern", default=t.PLACEHOLDER, help="pattern of a placeholder; its group is the name")
    track = sub.add_parser("track", help="log statements that commits add, remove and revise, as CSV")
    track.add_argument("repository")
    track.add_argument("out")
    clone = sub.add_parser("clone", help="clone and check out subjects")
    clone.add_argument("subjects", help="CSV of url and commit")
    clone.add_argument("folder")
    return p


def statement_counts(statements: DataFrame) -> dict:
    counts = graph.statement_stats(statements).first()
    return {x: counts[x] for x in ("stmt_count", "stmt_w_id_count", "stmt_w_injection_count")}


def matching_paths(spark: SparkSession, statements: DataFrame, folder: str, args: argparse.Namespace) -> dict:
    lines = logs.log_loc_join(logs.parse_log_lines(tables.scan_logs(spark, folder)), statements)
    events = lines.select(F.col("file").alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("line_no").alias("seq"), F.col("event_id").alias("item"))
    held = sequences.rolling_sequences(events, window_us=args.window_size_ms * 1000, shortest=args.min_sequence_length, longest=args.max_sequence_length, limit=args.max_dataset_size)
    return {"matching_paths_count": sequences.path_support(held, graph.paths(statements).select("path"), support=args.min_support).count()}


def track(spark: SparkSession, repositories: DataFrame) -> DataFrame:
    """Per commit, in walk order, the log calls that are old, new and revised in the diffs to its parents."""
    commits = tables.stored(git.read_commits(repositories), "commits")
    calls = diff.diff_log_calls(diff.diff_spans(diff.java_lines(git.read_hunk_lines(commits))))
    return diff.diff_track(commits.select("repository", "walk_order", "commit", "timestamp", F.size("parents").alias("parents")), calls)


def project(spark: SparkSession, root: str, args: argparse.Namespace) -> None:
    """One project's graph or results, in its own files."""
    if args.what == "graph":
        rows = java.extract_statements(tables.scan_source(spark, f"{args.launcher}:{root}"))
        return tables.write_graph(graph.project_statements(rows), f"{root}/{GRAPH}")
    statements = tables.read_graph(spark, f"{root}/{GRAPH}")
    result = statement_counts(statements) if args.what == "stats" else matching_paths(spark, statements, root, args)
    return tables.write_json(spark, f"{root}/{RESULTS[args.what]}", result)


def run(spark: SparkSession, args: argparse.Namespace) -> dict | None:
    result = None
    if args.command == "output":
        tables.write_statements(java.extract_statements(tables.scan_source(spark, args.environment)), args.out)
    elif args.command == "injections":
        names = spark.read.text(args.ids).select(F.trim("value").alias("name")) if args.ids else None
        reports = java.injection_reports(tables.scan_source(spark, args.environment), names)
        reports.select("source").write.option("quoteAll", True).option("escape", '"').csv(args.out)
    elif args.command == "stats":
        result = statement_counts(tables.read_statements(spark, args.statements))
    elif args.command == "compare":
        result = matching_paths(spark, graph.project_statements(tables.read_statements(spark, args.statements)), args.logs, args)
    elif args.command == "projects":
        result = {}
        for root in tables.folders(spark, args.root):
            try:
                project(spark, root, args)
                result[root] = "done"
            except Exception as e:  # one project's failure is told, and the others go on
                traceback.print_exc()
                result[root] = f"{type(e).__name__}: {str(e)[:200]}"
            if args.verbose:
                print(f"{root}: {result[root]}", file=sys.stderr)
    elif args.command == "parse":
        kinds = tables.read_templates(spark, args.templates)
        parsed = templates.parse_logs(tables.scan_logs(spark, args.logs, "*"), kinds, form=args.format, variable=args.variable_pattern)
        templates.as_json(parsed).orderBy("file", "line_no").select("value").write.text(args.out)
    elif args.command == "stat":
        rows = templates.as_lists(templates.template_stat(tables.read_templates(spark, args.templates), args.variable_pattern))
        rows.write.option("escape", '"').option("emptyValue", "").csv(args.out)
    elif args.command == "track":
        track(spark, spark.createDataFrame([(args.repository,)], "repository string")).orderBy("walk_order").write.option("header", True).csv(args.out)
    else:
        rows = git.clone(spark.read.schema("url string, commit string").csv(args.subjects), args.folder).collect()
        result = {r["url"]: r["error"] or "done" for r in rows}
    if result is not None and getattr(args, "output", None):
        tables.write_json(spark, args.output, result)
    return result


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH", "")) if x)
    result = run(SparkSession.builder.appName("logweave").getOrCreate(), args)
    if result is not None and not getattr(args, "output", None):
        print(json.dumps(result))


if __name__ == "__main__":
    main()
