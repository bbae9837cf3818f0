"""Metric aggregations; missing values (null or NaN) are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def summary(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, n, mean, std): population deviation."""
    v = df.select(*by, known(value).alias("v"))
    return v.groupBy(*by).agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


def cohen_d(df: DataFrame, a: Column, b: Column, value: Column) -> DataFrame:
    """(d): difference of means over the pooled sample deviation; null for fewer than two values or no spread."""
    va, vb = F.when(a, known(value)), F.when(b, known(value))
    g = df.agg(F.avg(va).alias("ma"), F.var_samp(va).alias("va"), F.count(va).alias("na"), F.avg(vb).alias("mb"), F.var_samp(vb).alias("vb"), F.count(vb).alias("nb"))
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2) & (F.col("va") + F.col("vb") > 0)
    return g.select(F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("d"))


def paired_wins(df: DataFrame, a: str, b: str, direction: int = 1) -> DataFrame:
    """(pairs, wins): rows with both sides, and those where a beats b."""
    both = df.where(known(F.col(a)).isNotNull() & known(F.col(b)).isNotNull())
    return both.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(((F.col(a) - F.col(b)) * direction > 0).cast("long")), F.lit(0)).alias("wins"))


def accuracy_rollup(df: DataFrame, category: str, hit: str) -> DataFrame:
    """(category, n, hits, accuracy) and a TOTAL row."""
    r = df.rollup(category).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("int")).alias("hits"), F.round(F.avg(F.col(hit).cast("int")), 6).alias("accuracy"))
    return r.withColumn(category, F.coalesce(F.col(category), F.lit("TOTAL")))


def nan_to_mean(value: str, batch: str) -> Column:
    v = known(F.col(value))
    return F.coalesce(v, F.avg(v).over(W.partitionBy(batch)))


def weighted(parts: dict[str, tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for w, c in parts.values():
        total = total + F.lit(w) * c
    return total
