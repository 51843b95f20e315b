import pytest

#: Nulls, empty texts, ties, repeated rows, a long text, and columns whose names could clash.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away home", "en"),
    (2, None, "en"),
    (3, "", None),
    (3, "", None),
    (4, " the QUICK brown fox jumps over the lazy dog\tand runs far away home ", "en"),
    (None, "un deux trois quatre cinq six sept huit neuf dix onze", "fr"),
    (6, "1234 !!! ...", None),
    (7, "wort " * 30000, "de"),
    (8, "übergröße straße 中文 é", "de"),
    (9, "short", "en"),
    (9, "short", "en"),
]
COLUMNS = "doc_id long, text string, lang string, id long, n long, norm string, fp string, kept string, items string, start long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 0, "x", "x", "x", "x", 0) for r in ROWS], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
