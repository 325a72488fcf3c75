import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, n_words string, k1 string, id string, copy string, span string, start string, bucket string"
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows; columns with clashing names."""
    more = (1, "x", "y", "z", "c", "s", "t", "b")
    return [
        (1, None, "en", "a", 0, *more), (2, "", "en", "a", 0, *more), (3, " \n\t\n ", None, None, 3, *more), (4, LONG, "en", "a", len(LONG), *more), (5, LONG, "de", "b", len(LONG), *more),
        (6, "one two", "en", "b", 7, *more), (6, "one two", "en", "b", 7, *more), (None, "no id here, at all; really none", "en", "a", 1, *more), (7, "Été ςΣ İ 日本語 \U0001f600 end", "fr", None, 1, *more), (8, None, None, None, None, *[None] * 8),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
