import pytest
from made import CLASHING, SCHEMA, corpus


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs, sources = ["en", "de", None], ["web", "books", "code", None]
    return spark.createDataFrame([(i, t, langs[i % 3], sources[min(3, i % 7)], len(t or "")) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, i % 4 and 1, int(i % 9 == 0)) for i, _ in texts if i % 2], "doc_id long, quality long, toxic long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality long, toxic long")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, one doc_id twice, and further columns with clashing names."""
    long = "many words of a text that goes on and on with others " * 20
    rows = [(None, None, None, None, None), (None, long, None, "web", 3), (1, long, "en", "web", 1), (1, long, "en", "web", 1), (2, None, "en", None, 2), (2, "other text " * 60, None, "web", 2), (3, "", "de", "books", None), (4, long + "end", "de", "books", 9)]
    return spark.createDataFrame([r + tuple(range(len(CLASHING))) for r in rows], SCHEMA + "".join(f", {c} long" for c in CLASHING))
