import pytest

LONG = "Lorem ipsum dolor sit amet consectetur. " * 4000 + "end"
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 4), (4, LONG, "en", "b", len(LONG)), (5, LONG, "de", "c", len(LONG)),
    (None, "a text without an id, long enough to hold one hundred bytes of text that stand nowhere else in here, at all", "en", "a", 1),
    (6, "one two", "fr", "a", 7), (6, "one two", "fr", "a", 7), (6, "three four five", "fr", "b", 9), (7, "äöü 漢字 😀 ~~ <|endoftext|> İ", None, None, None),
    (8, "12345 !!! ???", "es", "a", 3), (9, "aaaa" * 200, "es", "a", 800),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated ids and rows, and clashing extra columns."""
    names = "fp string, at string, h string, n_lines string, leaks string, lang_pred string, score string, part string, ids string, doc string, word string, component_id string, kept string, `key` string"
    extra = [f"x{i}" for i in range(14)]
    return spark.createDataFrame([(*r, *extra) for r in ROWS], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}")


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS
