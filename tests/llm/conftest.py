import pytest

from cubespark.llm import steps  # noqa: F401  (registers the package's functions)

EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (id, text) pairs, with columns that clash with results."""

    def make(pairs):
        rows = [(i, t, None, "s", None if t is None else len(t), "x", "y", 1) for i, t in pairs]
        extra = ", id string, hash string, n bigint"
        return spark.createDataFrame(rows, EMPTY + extra).repartition(3)

    return make
