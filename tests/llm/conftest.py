import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like rows from texts; columns that an operator makes itself are there as well, to clash."""

    def make(*texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "src", -1, "x") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")

    return make
