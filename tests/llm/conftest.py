import pytest

from factorlake.llm.workers import importable

LONG = "word " * 30_000 + "end."


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like those the operators add."""
    rows = [(1, "alpha beta gamma delta", "en", "a", 22), (2, "alpha beta gamma delta", "en", "a", 22), (2, "alpha beta gamma delta", "en", "a", 22), (3, "", "en", None, 0), (4, None, None, "b", None),
            (None, "no id here at all", "en", "b", 17), (None, "no id here at all", None, None, 17), (5, LONG, "en", "c", None), (6, " \n\t ", "de", "c", 4), (7, "ALPHA beta\tgamma delta", "de", None, 22)]
    extra = "row long, pos int, name string, fp long, key string, h long, mark long, line string, score double, length int, offset int"
    return spark.createDataFrame([r + (9, 9, "x", 9, "k", 9, 9, "l", 0.5, 9, 9) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
