import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long text, ties and repeated rows."""
    long = "word " * 30_000
    return [
        (1, "alpha beta gamma delta epsilon", "en", "b", 30),
        (1, "alpha beta gamma delta epsilon", "en", "b", 30),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "a", 4),
        (5, long, "de", None, len(long)),
        (6, "one", "fr", "c", 3),
        (7, "12 + 3 = 15!", "fr", "c", 12),
        (8, "Alpha  beta\ngamma delta EPSILON", "en", "b", 31),
        (None, "no identifier here", "en", "d", 18),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with more columns, some named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns(
        {c: F.lit("x") for c in ("spans_", "part", "rep", "component", "key", "size", "taken", "row", "k")}
    )


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
