from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to documents with the columns of the table and one whose name clashes with an internal one."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("r", T.StringType()), T.StructField("row", T.LongType()),
    ])

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows], schema)

    return make
