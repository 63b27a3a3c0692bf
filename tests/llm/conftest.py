import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     T.StructField("key", T.StringType()), T.StructField("size", T.LongType())])  # the last two clash with working names


@pytest.fixture(scope="session")
def make(spark):
    def frame(texts):
        """Documents from texts or (id, text) pairs, with extra columns."""
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)
    return frame
