"""Small hand-made tables; the session and the given tables come from tests/conftest.py."""

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts or (doc_id, text) pairs, with further columns on request."""

    def build(texts, extra=None):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(d, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, (d, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, SCHEMA)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, F.lit(value))
        return df

    return build


@pytest.fixture(scope="session")
def long_text():
    """About 1 MB in one line."""
    return " ".join(f"word{i % 977}x{i % 61}" for i in range(95_000))


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
