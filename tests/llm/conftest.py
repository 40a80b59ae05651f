import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, key string"

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, a repeated row, clashing extra columns."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  ", "en", None, 2), (4, "a b", None, "s", 3), (5, "a \t\n b", "en", "s", 5), (5, "a \t\n b", "en", "s", 5),
        (6, LONG, "en", "s", len(LONG)), (7, LONG, "de", "s", len(LONG)), (8, "é" * 50, "fr", "s", 50), (9, "the quick brown fox jumps over the lazy dog", "en", "s", 43),
    ]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
