import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, score string, _features string, n string, rep string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows, a long text, and columns whose names the operators use themselves."""
    words = " ".join(f"w{k % 997}x{k % 13}" for k in range(30_000))
    texts = [(1, "The quick brown fox jumps over the lazy dog again"), (2, "the quick brown fox jumps over the LAZY dog again"), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "one two"), (7, "one two"), (None, "no id here at all"), (8, words), (9, words + " end"), (10, "größe \U0001f600 naïve x <|endoftext|> end")]
    rows = [(i, t, None if i == 1 else "en", None if i == 2 else "s", None, "a", "b", None, "d", "e") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, None, None), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
