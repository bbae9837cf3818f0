"""Seeded sampling without a generator: uniforms are hashes of ids, so every run, plan and
cluster gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(key: Column, draw: str) -> Column:
    """A number in (0, 1) for a key and a named draw."""
    h = F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(draw)).cast("binary")), F.lit(8)), 16, 10).cast("double")
    return (h + 0.5) / 4294967296.0


def weighted_sample(df: DataFrame, part: str, key: str, weight: Column, k: int, draw: str) -> DataFrame:
    """k rows of each part without replacement, chance by weight (exponential keys)."""
    order = F.round(-F.log(uniform(F.col(key), draw)) / weight, 9)
    return df.withColumn("rn", F.row_number().over(W.partitionBy(part).orderBy(order, key))).where(F.col("rn") <= k)


def softmax_pick(df: DataFrame, part: str, key: str, score: Column, temperature: float, draw: str) -> DataFrame:
    """(part, key): one row of each part, chance by softmax (Gumbel maximum); 0 or less takes the best."""
    noise = -F.log(-F.log(uniform(F.col(key), draw))) if temperature > 0 else F.lit(0.0)
    value = F.round(score / (temperature if temperature > 0 else 1.0) + noise, 9)
    return df.groupBy(part).agg(F.max_by(key, F.struct(value.alias("v"), F.col(key).alias("k"))).alias(key))


def capped(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """At most k rows of each group, in a fixed order (the feature is the cap itself).

    The condition on the row number lets Spark cut every group to k rows before the shuffle
    (``WindowGroupLimit``), so a group with a third of all rows costs its final task no more
    than k rows of each input partition.
    """
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def split_by_hash(key: Column, train_percent: int = 95) -> Column:
    h = F.conv(F.left(F.md5(key.cast("string").cast("binary")), F.lit(7)), 16, 10).cast("long")
    return F.when(h % 100 < train_percent, "train").otherwise("test")


def pick(pool: Column, key: Column, draw: str) -> Column:
    """One element of an array by the hash of a key; null from an empty one."""
    return F.get(pool, F.floor(uniform(key, draw) * F.size(pool)).cast("int"))


def regressed_scenes(goals: DataFrame, producers: DataFrame, pools: DataFrame, key: str = "goal_id") -> DataFrame:
    """(key, slot, value, verb, agent, theme, place): a scene set up so that a goal can be reached.

    For each goal one producing verb is drawn among its producers (slot, value, verbs), and
    concepts for its roles from the pools (kind, concepts), all by hashes of the goal's key.
    Goals nobody can produce have no scene.  Pools and producers are small dimensions.
    """
    k = F.col(key)
    p = {r["kind"]: r["concepts"] for r in pools.collect()}  # a few kinds with their concept lists
    arr = lambda kind: F.array(*[F.lit(c) for c in p.get(kind, [])]).cast("array<string>")
    g = goals.join(producers, ["slot", "value"])
    return g.select(key, "slot", "value", pick(F.col("verbs"), k, "verb").alias("verb"), pick(arr("person"), k, "agent").alias("agent"), pick(arr("artifact"), k, "theme").alias("theme"), pick(arr("location"), k, "place").alias("place"))
