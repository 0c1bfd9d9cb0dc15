"""Queries over the whole of their input, on small tables."""

import itertools
from collections import Counter

from pyspark.sql import functions as F

from logweave.plans import queries as core


def write_events(spark, folder, types):
    """events(event_id, user_id, ts, event_type) of types: by user, the event types of an hour's events, in order."""
    rows = [(u * 1000 + i, u, 1_700_000_000 + 60 * i, x) for u, xs in types.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at long, event_type string")
    df.select("event_id", "user_id", F.timestamp_seconds("at").alias("ts"), "event_type").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def dominators_of(xs):
    """By node, its dominators but itself, nearest last: those without which the root does not reach it."""
    edges = set(zip(xs, xs[1:], strict=False))

    def reach(gone):
        seen, todo = set(), [xs[0]] if gone != xs[0] else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x and b != gone]
        return seen

    over = {x: {d for d in xs if d != x and x not in reach(d)} for x in xs}
    return {x: sorted(ds, key=lambda d: len(over[d])) for x, ds in over.items() if x != xs[0]}


def test_dominators_of_long_users(spark, tmp_path):
    types = {1: "signup view click signup view click error purchase error".split(), 2: "click view error click view error click purchase".split(), 3: "view click".split(), 4: ["view"], 5: "signup view click purchase signup signup signup purchase".split()}
    sf_dir = write_events(spark, tmp_path, types)
    want = {(u, x): ds for u, xs in types.items() for x, ds in dominators_of(xs).items()}
    idom = {(r["method"], r["node"]): r["idom"] for r in core.QUERIES["cfg_dominators"](spark, sf_dir).collect()}
    assert idom == {k: ds[-1] for k, ds in want.items()}
    log = {(r["method"], r["node"]): r["log_idom"] for r in core.QUERIES["cfg_log_idom"](spark, sf_dir).collect()}
    assert log == {k: next((d for d in reversed(ds) if d in ("error", "view")), None) for k, ds in want.items()}
    assert idom[1, "purchase"] == "error" and idom[5, "purchase"] == "signup"


def test_patterns_of_more_than_three_items(spark, tmp_path):
    kinds = ["signup view click purchase error view".split(), "view click click view error".split()]
    types = {u: kinds[u % 2] for u in range(520)}
    sf_dir = write_events(spark, tmp_path, types)
    support = Counter()
    for xs in types.values():
        for n in range(2, len(xs) + 1):
            support.update({x for k in range(1, n + 1) for x in itertools.combinations(xs[:n], k)})
    want = {">".join(p): n for p, n in support.items() if n >= 500}
    got = {r["path"]: r["support"] for r in core.QUERIES["frequent_patterns"](spark, sf_dir).collect()}
    assert got == want and any(p.count(">") >= 3 for p in want)
