import pytest


@pytest.fixture()
def docs(spark):
    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
        n = len(columns.split(", "))
        return spark.createDataFrame([tuple(r) + (None,) * (n - len(r)) for r in rows], columns)

    return make
