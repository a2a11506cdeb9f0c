import pytest

from medley.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with NULLs, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}." for i in range(12_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "The quick  brown fox jumps over the lazy dog", "en", "b", 44),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b\f\r", "en", "a", 6),
        (None, "orphan text without an id", "en", None, 25),
        (6, long, "en", "a", len(long)),
        (7, long + " more", "en", "a", len(long) + 5),
        (8, "12345 !!! ???", None, "c", 13),
        (9, "Größe und Straße überall für ältere Mädchen", "de", "b", 43),
        (-5, "漢字 かな 交じり文 text é é \U0001f600", "xx", "\U0001f600", 20),
        (10, "one", "en", "é", 3),
        (11, "one two", "en", "e", 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame(rows, schema)
    extra = docs.selectExpr(
        "*", "'x' AS lang_pred", "'y' AS score", "1 AS fp", "2 AS component_id", "3 AS size", "4 AS digest", "5 AS row", "6 AS part", "7 AS turn", "8 AS `range`"
    )
    return extra.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
