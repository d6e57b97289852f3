import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, ids array<string>, item int, `range` int"

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "one", "en", "b", 3),
    (4, "one two three", None, None, 13),
    (5, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (5, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (6, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 59),
    (7, "  \t\n ", "en", "b", 5),
    (None, "no identifier here at all", "en", "a", 25),
    (8, "x" * 30000, "en", "c", 30000),
    (9, "word " * 20000, "en", "c", 100000),
    (10, "日本語 と 한국어 😀 ½ ª \x1c end", "xx", "c", 20),
    (-3, "negative identifiers are identifiers too", "en", "c", 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 0.5, "s", ["i"], 1, 2) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
