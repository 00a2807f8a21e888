import pytest
from helpers import SF


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text[, lang, source]); with columns whose names clash with the operators' own."""

    def make(*rows):
        full = [(k, r, "en", "s") if r is None or isinstance(r, str) else (*r, *("en", "s")[len(r) - 2 :]) for k, r in enumerate(rows)]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        return df.selectExpr("*", "1 as n_tokens", "'x' as bucket", "2 as n", "'y' as row", "3 as key", "4 as spans", "length(text) as n_chars")

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
