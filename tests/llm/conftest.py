import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .cases import SF

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                  StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """(id, text) pairs as a documents table with further columns, some of clashing names."""

    def make(rows, lang="en", source="s", extra=False):
        data = [(i, t, lang, source, None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, DOC)
        if extra:
            for name in ("score", "fp", "component_id", "copy", "shuffle_key", "rate", "_src", "spans", "kept", "Predicted"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")

