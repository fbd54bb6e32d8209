import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) with columns beside them whose names clash with results."""
    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("score", F.lit("x")).withColumn("fp", F.lit("y")).withColumn("key", F.lit(1)).withColumn("component_id", F.lit(-1))
    return make
