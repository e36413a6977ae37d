import pytest


@pytest.fixture
def table(spark):
    """Makes a table of rows with a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


DOCS = "doc_id long, text string"
