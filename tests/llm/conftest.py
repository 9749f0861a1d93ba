import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every trouble at once: nulls, empties, repeats, a very long text, clashing extra columns."""
    words = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "a", "x", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "a", "x", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "a", "x", 1),
        (3, None, None, None, None),
        (4, "", "", "x", 1),
        (5, " \n\t ", "b", "x", 1),
        (None, "alpha beta gamma", "b", None, 1),
        (None, None, None, None, None),
        (20, words, "hot", "x", 1),
        (40, words + " end", "hot", "x", 1),
        (60, "One two", "b", "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, size int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
