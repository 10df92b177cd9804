import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a schema string -> a frame spread over a few partitions."""
    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make
