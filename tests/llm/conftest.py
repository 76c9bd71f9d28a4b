import pytest
from pyspark.sql import Row


@pytest.fixture
def table(spark):
    """A table of documents with columns besides id and text, some of which clash."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, TEXT string"):
        return spark.createDataFrame([Row(i, t, "en", None, len(t or ""), "other") for i, t in rows], schema)

    return make
