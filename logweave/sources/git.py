"""Commits and diffs of git repositories, read by the plain git program in the tasks that need them.

repositories(repository, ...): paths that every executor can read.  A repository's commits are one task; its diffs are
dealt by commit and parent, so a long history is shared out.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMITS = "repository string, walk_order long, commit string, timestamp long, parents array<string>"
HUNK_LINES = "repository string, commit string, parent_no int, path string, is_binary boolean, hunk int, line_no int, origin string, content string"
# Four lines of context, changes of white space ignored, the patience and minimal algorithms, indentation kept in view.
DIFF = ["--unified=4", "--ignore-space-change", "--patience", "--minimal", "--indent-heuristic"]


def git(repository: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-c", "diff.noprefix=false", "-C", repository, *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} in {repository}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="replace")


def read_commits(repositories: DataFrame) -> DataFrame:
    """Commits that HEAD reaches, parents before children, by time where that leaves a choice."""

    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for repository in f["repository"]:
                lines = git(repository, "log", "--reverse", "--topo-order", "--format=%H %ct %P", "HEAD").splitlines()
                rows = [(repository, i, x[0], int(x[1]), x[2:]) for i, x in enumerate(line.split() for line in lines)]
                yield pd.DataFrame(rows, columns=["repository", "walk_order", "commit", "timestamp", "parents"])

    return repositories.select("repository").mapInPandas(kernel, COMMITS)


def parse_diff(text: str) -> Iterator[tuple[str, bool, int, int, str, str]]:
    """(path, is_binary, hunk, line_no, origin, content) of every line of a diff's hunks, and one row of a binary patch.

    The path is the new one, or the old one of a removed file.  The origin of a missing end of line tells after what it
    stands: > after an old line, < after a new one, = after a common one.
    """
    path, old, hunk, no, left, right, last = "", "", -1, 0, 0, 0, " "
    for line in text.split("\n"):
        if left or right:
            origin = line[:1] or " "
            if origin in " +-":
                yield path, False, hunk, no, origin, line[1:]
                left, right, last, no = left - (origin != "+"), right - (origin != "-"), origin, no + 1
                continue
        if line.startswith("\\") and hunk >= 0:
            yield path, False, hunk, no, {"-": ">", "+": "<"}.get(last, "="), line
            no += 1
        elif line.startswith("diff --git "):
            path, old, hunk = line[11:].partition(" b/")[2], "", -1
        elif line.startswith("--- "):
            old = name(line[4:])
        elif line.startswith("+++ "):
            path = name(line[4:]) or old
        elif line.startswith("Binary files "):
            yield path, True, 0, 0, "B", line
        elif line.startswith("@@ "):
            hunk, no = hunk + 1, 0
            a, b = line.split(" ")[1:3]
            left, right = (int(x.partition(",")[2] or 1) for x in (a, b))


def name(text: str) -> str:
    """The path of a --- or +++ line; empty for /dev/null."""
    text = text.split("\t")[0]
    if text.startswith('"') and text.endswith('"'):
        text = text[1:-1].encode().decode("unicode_escape")
    return "" if text == "/dev/null" else text[2:]


def read_hunk_lines(commits: DataFrame) -> DataFrame:
    """Lines of the diffs from each commit to each of its parents: a line that the commit adds has origin -, one that it
    removes +.  A commit without parents has none."""

    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in HUNK_LINES.split(", ")]
        for f in frames:
            for repository, commit, no, parent in zip(f["repository"], f["commit"], f["parent_no"], f["parent"], strict=True):
                rows = [(repository, commit, no, *x) for x in parse_diff(git(repository, "diff", *DIFF, commit, parent))]
                yield pd.DataFrame(rows, columns=names)

    pairs = commits.select("repository", "commit", F.posexplode("parents").alias("parent_no", "parent"))
    # By commit, not by repository: one long history must not be one task.
    return pairs.repartition("commit", "parent").mapInPandas(kernel, HUNK_LINES)


def clone(subjects: DataFrame, folder: str) -> DataFrame:
    """(url, commit, repository, error) of subjects(url, commit): each is cloned below a shared folder and checked out.

    A subject that fails has an error, and the others go on.  A clone that is there already is used again.
    """

    def kernel(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for url, commit in zip(f["url"], f["commit"], strict=True):
                at = f"{folder.rstrip('/')}/{url.rstrip('/').rpartition('/')[2].removesuffix('.git')}"
                error = None
                for args in (["git", "clone", "--quiet", url, at], ["git", "-c", "safe.directory=*", "-C", at, "checkout", "--quiet", commit]):
                    if args[1] == "clone" and subprocess.run(["git", "-c", "safe.directory=*", "-C", at, "rev-parse", "--git-dir"], capture_output=True, check=False).returncode == 0:
                        continue
                    done = subprocess.run(args, capture_output=True, check=False)
                    error = error or (done.stderr.decode(errors="replace").strip() if done.returncode else None)
                rows.append((url, commit, at, error))
            yield pd.DataFrame(rows, columns=["url", "commit", "repository", "error"])

    return subjects.select("url", "commit").repartition("url").mapInPandas(kernel, "url string, commit string, repository string, error string")
