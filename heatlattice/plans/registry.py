"""Queries by name, each with its SQL for the other engine where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Doubles rounded to ``places`` of their column, so that the last bits of two engines cannot differ."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files are fewer than these: a file of one row group is one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compiled(spark: SparkSession) -> None:
    """Lets long expressions be compiled: the JVM compiles no method of over 8,000 bytes, and below that limit Spark cuts them into small ones."""
    if int(spark.conf.get(METHOD_LIMIT)) > 8000:
        spark.conf.set(METHOD_LIMIT, "8000")
