import pytest

from gridspark.llm.base import ROOT


@pytest.fixture(scope="session", autouse=True)
def worker_path(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def make(pairs, source="src0"):
        rows = [(i, t, "en", source, None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


def prose(seed, n):
    """``n`` invented words that depend on ``seed``."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(n))
