import pytest


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A function that writes tables as Parquet and returns their folder."""

    def put(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return put


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A function that makes documents from texts; ids count from 0."""

    def make(texts, langs=None, sources=None):
        rows = [(k, t, langs[k] if langs else "en", sources[k] if sources else "s", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names clash."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 3), (4, "one", "en", None, 3),
        (5, "word " * 30_000, "en", "s", 150_000), (5, "word " * 30_000, "en", "s", 150_000), (None, "no id here", "en", "s", 10),
        (6, "x" * 200_000, None, "s", 200_000), (7, "1" * 50_000, "en", "s", 50_000), (8, "a@b.co" + ".a" * 20_000, "en", "s", 40_006),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "component", "key", "line", "words", "hash", "_row", "_id", "_keep", "taken_", "row", "at"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
