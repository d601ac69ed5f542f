import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text, lang, source); ``row`` and ``score`` are extra columns with clashing names."""

    def make(*rows):
        return spark.createDataFrame([(i, t, lang, src, "x", "y") for i, t, lang, src in rows], DOCS)

    return make
