import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, u long, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns that clash."""
    long_text = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None, 1, 1, 1, "k"),
        (2, "", None, None, 0, None, None, None, None),
        (3, "   \n\t ", "en", "a", 5, 1, 1, 1, "k"),
        (4, "one two", "en", "a", 7, 1, 1, 1, "k"),
        (5, "one two", "en", "a", 7, 1, 1, 1, "k"),
        (5, "one two", "en", "a", 7, 1, 1, 1, "k"),
        (None, "Ünï <|endoftext|>  wide space \x1c é", "de", "b", 20, 2, 2, 2, "k"),
        (6, long_text, "en", "b", len(long_text), 2, 2, 2, "k"),
        (7, "x" * 20_000, "en", "b", 20_000, 2, 2, 2, "k"),
        (8, "1" * 6_000 + " a@b.c " + "1.2.3.4", "en", "b", 1, 2, 2, 2, "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
