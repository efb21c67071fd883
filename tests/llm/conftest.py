import pytest

from .data import edge_rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeats, and extra columns whose names operators use inside."""
    rows = [(i, t, "xx", 1, "s", 0.5, "n", 7) for i, t in edge_rows()]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, node int, facts string, score double, row string, class int"
    )


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
