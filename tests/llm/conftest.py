import pytest

ODD_TEXTS = [None, "", " \n\t", "one", "one two", "a b c d e f", "a b c d e f", "x" * 5000, "word " * 3000, "é ü ñ 漢字 😀", "<|endoftext|> ▁ <s> <0x0A>"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(k if k != 9 else None, t, None if k % 3 else "en", None, None, "x", 1) for k, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, n_chars long, _text string, score int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
