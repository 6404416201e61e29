import pytest


@pytest.fixture(scope="module")
def documents(spark):
    """Rows that every operator has to take: nulls, empty and blank texts, repeats, one long text, clashing columns."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
    rows = [
        (1, "one two three four five six seven eight nine ten\nalpha beta gamma delta epsilon zeta eta theta iota", "en", "src0", 5, "a"),
        (2, "one two three four five six seven eight nine ten\nalpha beta gamma delta epsilon zeta eta theta iota", "en", "src0", 5, "b"),
        (3, None, None, None, None, None),
        (4, "", "en", "src1", 0, "c"),
        (5, " \t\r\n\x0b ", "en", "src1", 3, "d"),
        (None, "one two three four five six seven eight nine ten", "en", "src1", 3, "e"),
        (6, long, "de", "src2", None, "f"),
        (6, long, "de", "src2", None, "f"),
        (7, "one two", "en", None, 7, None),
        (8, "ein wort été \U0001f600 one two three four five six seven eight nine ten", "fr", "src2", 9, "g"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.where("1 = 0")
