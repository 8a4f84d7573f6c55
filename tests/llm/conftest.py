import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts; a text may be a pair of id and text."""

    def docs(*texts, **more):
        rows = []
        for i, t in enumerate(texts):
            i, t = t if isinstance(t, tuple) else (i, t)
            rows.append((i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t)))
        return spark.createDataFrame(rows, DOCS)

    return docs


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
