import pytest
from pyspark.sql import functions as F

from tests.llm import cases


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns named like those of the operators."""
    return docs.withColumns({c: F.lit("own") for c in cases.CLASHES})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
