import pytest


@pytest.fixture(autouse=True)
def _quiet(spark):
    spark.sparkContext.setLogLevel("ERROR")
