import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture
def docs(spark):
    """A function from (doc_id, text) or (doc_id, text, lang, source) rows to a table like documents, with clashing extra columns."""

    def make(rows, key="long", place="string", size="long"):
        full = [(*r, *(None,) * (4 - len(r)), 1, "x", 2) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, key int, component string, n int")

    return make
