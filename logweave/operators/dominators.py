"""Dominators of control-flow graphs, one group per method."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def immediate_dominators(edges: dict[int, list[int]], root: int) -> dict[int, int]:
    """The immediate dominator of each vertex that the root reaches, by fixpoint over reverse postorder."""
    order, seen, stack = [], {root}, [(root, iter(edges.get(root, ())))]
    while stack:
        node, rest = stack[-1]
        for x in rest:
            if x not in seen:
                seen.add(x)
                stack.append((x, iter(edges.get(x, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    number = {x: i for i, x in enumerate(order)}
    before: dict[int, list[int]] = {x: [] for x in order}
    for x in order:
        for y in edges.get(x, ()):
            before[y].append(x)
    idom = {root: root}
    changed = True
    while changed:
        changed = False
        for x in reversed(order[:-1]):
            new = None
            for p in before[x]:
                if p in idom:
                    a, b = p, p if new is None else new
                    while a != b:
                        while number[a] < number[b]:
                            a = idom[a]
                        while number[b] < number[a]:
                            b = idom[b]
                    new = a
            if idom.get(x) != new:
                idom[x], changed = new, True
    del idom[root]
    return idom


def dominators(edges: DataFrame, node_type: str = "string") -> DataFrame:
    """(method, node, idom, log_idom) from edges(method, src, dst, root, is_log): idom of all but the root.

    log_idom is the nearest dominator that is a log event; is_log says so of src, and a vertex without edges is none.
    """

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for a, b in zip(rows["src"], rows["dst"], strict=True):
            out.setdefault(a, []).append(b)
        log = set(rows.loc[rows["is_log"], "src"])
        idom = immediate_dominators(out, rows["root"].iloc[0])
        found = []
        for x in sorted(idom):
            up = idom[x]
            while up in idom and up not in log:
                up = idom[up]
            found.append((rows["method"].iloc[0], x, idom[x], up if up in log else None))
        return pd.DataFrame(found, columns=["method", "node", "idom", "log_idom"])

    method = edges.schema["method"].dataType.simpleString()
    return edges.groupBy("method").applyInPandas(kernel, f"method {method}, node {node_type}, idom {node_type}, log_idom {node_type}")
