"""Queries over the driver tables: one per operator, with an ANSI SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS place
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey
""")
def shared_container_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("place"))
    b = s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("place"))
    return a.join(b, "place").select("a", "b", "place")
