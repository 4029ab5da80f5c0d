import pytest


@pytest.fixture
def frame(spark):
    """Builds a frame of documents with a clashing extra column."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, fp string"):
        n = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + ("x",) * (n - len(r)) if isinstance(r, (list, tuple)) else r for r in rows], schema)

    return make
