import pytest

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make
