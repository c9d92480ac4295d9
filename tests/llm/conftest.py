import pytest
from llm_helpers import SF
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text) as a table with clashing and extra columns."""
    def make(rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        return df.withColumns({"kept": F.lit("x"), "t": F.lit(1), "k": F.lit(2), "fp": F.lit(0), "score": F.lit(0.5),
                               "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    return make

