import pytest

LONG = "the quick brown fox jumps over the lazy dog " * 3_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, words string, size string, cluster string, unit string, item_id long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and more columns whose names operators use within."""
    rows = [
        (1, "Hello there, this is a plain text of some words.", "en", "s0"),
        (1, "Hello there, this is a plain text of some words.", "en", "s0"),
        (2, "Hello there, this is a plain text of some words.", None, None),
        (3, None, "en", "s1"),
        (None, "A text without an id.", "en", "s1"),
        (4, "", None, "s1"),
        (5, "   \t\n", "en", "s1"),
        (6, LONG, "en", "s0"),
        (7, "Où est la bibliothèque, s'il vous plaît? Ça va très bien.", "fr", "s2"),
        (8, "12345 %%% ###", "fr", "s2"),
        (9, "x", "en", "s2"),
        (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, None, "fp", "w", "z", "c", "u", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
