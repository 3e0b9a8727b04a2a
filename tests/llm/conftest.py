import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    """documents of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977} the" for k in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "de", "b"), (5, "one", "de", "b"), (5, "one", "de", "b"),
        (6, long, "en", None), (7, "123 456\n!!!", "en", "a"), (8, "Two words", None, "a"), (None, "lost id", "en", "a"), (9, "x\x1cy\x85z\x0bq", "en", "b"),
    ]
    return docs(rows)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators use inside."""
    names = ("id", "size", "key", "fp", "rep", "component", "bucket", "leaf", "lines", "score", "ids", "decoded", "value", "slot")
    return lambda df: df.withColumns({n: F.lit("x") for n in names})
