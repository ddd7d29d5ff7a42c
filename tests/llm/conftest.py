import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def make(spark):
    """make([(doc_id, text), ...], extra columns named like inner ones) -> documents."""
    def rows(pairs, partitions=3):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               *[T.StructField(c, T.StringType()) for c in ("key", "length", "shard", "_text", "n", "rank")]])
        return spark.createDataFrame([(a, b, "x", "y", "z", "w", "v", "u") for a, b in pairs], schema).repartition(partitions)
    return rows
