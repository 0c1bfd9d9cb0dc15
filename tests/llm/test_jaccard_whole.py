"""The set-similarity join's lists, and classes of rows without an id."""

import numpy as np

from logweave.llm import jaccard


def test_only_fitting_blocks_of_lists_are_read():
    rng = np.random.default_rng(5)
    parts = [np.sort(rng.choice(5000, n, replace=False)) for n in (1, 64, 65, 900, 4000)]
    lists, b = np.concatenate(parts).astype(np.int32), np.cumsum([len(x) for x in parts])
    a = b - [len(x) for x in parts]
    for lo, hi in ((0, 5000), (1000, 1200), (4999, 5000), (2000, 2000), (0, 1)):
        x, y = jaccard.within(lists, a, b, lo, hi)
        for k, part in enumerate(parts):
            want = part if len(part) <= jaccard.SHORT else part[(part >= lo) & (part < hi)]
            assert lists[x[k] : y[k]].tolist() == want.tolist()


def test_joined_from_fitting_blocks():
    rng = np.random.default_rng(6)
    base = np.sort(rng.integers(0, 1 << 62, 3000, dtype=np.uint64))
    sets = [base[np.sort(rng.choice(3000, int(n), replace=False))] for n in rng.integers(200, 3000, 200)]
    got = {i: sorted(hits.tolist()) for i, hits in jaccard.overlaps_join(sets, sets, 75)}
    inter = lambda x, y: len(np.intersect1d(x, y, True))
    assert got == {i: [j for j, y in enumerate(sets) if 100 * (n := inter(x, y)) >= 75 * (len(x) + len(y) - n)] for i, x in enumerate(sets)}


def test_rows_without_id_are_partners(spark):
    words = [[f"{x}{i}" for i in range(60)] for x in "abc"]
    a, b, x = (" ".join(w) for w in words)
    rows = [(1, a), (None, a + " y"), (None, a + " y"), (2, a + " z"), (None, b), (None, b + " y"), (3, x), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in jaccard.jaccard_join(docs).collect())
    assert got == sorted([("1", "1", 3), ("None", "None", 3), ("None", "None", 3), ("2", "1", 3), ("None", "None", 1), ("None", "None", 1), ("3", "3", 0), ("None", "None", 0)])
