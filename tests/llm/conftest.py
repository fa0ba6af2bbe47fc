import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i} and more" for i in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog today.\nA second line with some more words in it.", "x", 1),
        (2, "The quick brown fox jumps over the lazy dog today.\nAnother line that is its own and long enough.", "x", 2),
        (2, "The quick brown fox jumps over the lazy dog today.\nAnother line that is its own and long enough.", "x", 2),
        (3, None, None, None),
        (4, "", "y", 4),
        (5, "   \n\t ", "y", 5),
        (6, "one", "z", 6),
        (None, "no id here but some words all the same", "z", None),
        (-9, long, "z", 9),
        (8, "Ünïcödé İ 😀 漢字 ␛ ▁ \u0000 x", None, 8),
        (8, "a different text under the same id", None, 8),
    ]
    names = "doc_id long, text string, simhash string, formatted long"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def nothing(spark, documents):
    return spark.createDataFrame([], documents.schema)
