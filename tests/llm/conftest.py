import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, "the same text here", "en", "a", 18), (2, "the same text here", "en", None, None), (2, "the same text here", "en", None, None),
        (3, None, None, None, None), (4, "", "en", "a", 0), (None, "no id at all", "en", "a", 3), (5, "wörter üb er " * 20000, "de", "b", 1),
        (6, "Ünïcode 😀 ▁    x\n\n y\tz ", None, "b", 2), (7, "x" * 5000, "en", "a", 5000), (8, " ", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC)
