import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string"


@pytest.fixture
def documents(spark):
    """Rows of documents with a column more; a text alone is enough."""

    def make(rows):
        full = [(i, t, *(rest or ("en", "s"))) for i, t, *rest in ((r[0], r[1], *(r[2:])) for r in rows)]
        return spark.createDataFrame([(i, t, x[0], x[1], None if t is None else len(t), "h") for i, t, *x in full], DOCS)

    return make


@pytest.fixture
def saved(spark, tmp_path):
    """Save tables as a data directory."""

    def save(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save
