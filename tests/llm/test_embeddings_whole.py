"""Embeddings without a vec_id that are near others without being equal to one that has it."""

from logweave.llm import embeddings


def test_rows_without_id_are_partners(spark):
    near = lambda x: [1.0, x, 0.0, 0.0]
    rows = [(1, near(0.0)), (2, near(0.3)), (None, near(0.15)), (None, near(0.15)), (3, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.1]), (None, [0.0, 0.0, 0.0, 1.0]), (-5, [0.0, 0.0, 0.0, -1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 3, 1, True), (2, 3, 1, False), (None, 3, None, False), (None, 3, None, False), (3, 1, 3, True), (None, 1, None, False), (None, 0, None, False), (-5, 0, -5, True)]))
