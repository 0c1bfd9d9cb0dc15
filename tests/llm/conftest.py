import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, role string, bucket long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(1, words), (2, words + " x"), (3, words), (4, None), (5, ""), (6, "  \n "), (7, "one two"), (7, "one two"), (8, "One  two"), (None, words), (None, None), (9, "é" * 300_000), (10, "a b c " * 20_000), (-11, "\x00 <|endoftext|> 'İ! ß")]
    return spark.createDataFrame([(i, t, "en", "s" if i and i % 2 else None, len(t or ""), "k", "r", 3) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
