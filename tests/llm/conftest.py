import pytest


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as a Parquet table of several files and reads it."""
    n = iter(range(1000))

    def make(rows, ddl, parts=3):
        path = f"file://{tmp_path_factory.mktemp('t')}/{next(n)}"
        spark.createDataFrame(rows, ddl).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


#: A case of each kind that every operator must take: nulls, empty and long texts, repeated rows.
EDGES = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "no id here at all"), (3, None), (4, ""), (5, " \t\n"), (6, "word " * 30000), (7, "x" * 100_000)]
DDL = "doc_id long, text string, lang string, source string, n_chars long, _key string"


@pytest.fixture(scope="session")
def edges(table):
    return table([(i, t, None if i == 3 else "en", None, len(t or ""), "own") for i, t in EDGES], DDL)


@pytest.fixture(scope="session")
def empty(table):
    return table([], DDL)
