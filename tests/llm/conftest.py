import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A table like documents, of (doc_id, text) pairs, with a column whose name clashes with those of results."""

    def build(rows, lang="en"):
        full = [(k, t, lang if t else None, None, None) for k, t in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", "'x' AS score", "1 AS n_words", "'y' AS fp", "true AS held_out")

    return build


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, white space alone, a null key, a repeated row, a very long text and one long word."""
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a text without a key"), (4, "said twice, row by row"), (4, "said twice, row by row"), (5, "long text of words. " * 20_000), (6, "x" * 200_000), (7, "日本語 ß é \U0001f600 ▁ \x00 ok")]
