import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash with an operator's own."""
    long = "wort " * 30_000
    rows = [
        (1, "one two three four five six seven", None, None, None, "x"),
        (2, "one two three four five six seven", "en", "s", 3, None),
        (2, "one two three four five six seven", "en", "s", 3, None),
        (3, None, None, None, None, None),
        (4, "", "en", "s", 0, "x"),
        (None, "no id here", "en", "s", 1, "x"),
        (6, long, "de", "s", 9, "x"),
        (7, "\n\n \t\x0b", "de", "s", 9, "x"),
        (8, "Ünïcode   \U0001f600 ｘ", "de", "s", 9, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "1 as w0", "'c' as component", "2 as label", "3 as shard", "4 as node", "5 as sequence_id")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
