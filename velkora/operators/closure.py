"""Reachability over edge tables, many graphs at once.

Semi-naive loop: only pairs found in the last round are extended, and pairs already
known leave by an anti join.  Lineage is cut every round in the shared folder.  The
loop ends with an empty delta, so cycles are harmless.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import saved

def closure(edges: DataFrame, part: str | None = None, directed: bool = True, max_depth: int | None = None, reflexive: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """(part, src, dst, depth) pairs linked by a path of at most ``max_depth`` edges.

    ``edges`` has (part, src, dst); ``seeds`` (part, src) restricts the starting points.
    ``depth`` is the least number of edges.  Null ends are ignored; self-loops and
    repeated edges change nothing.  Undirected: no node reaches itself by going back.
    """
    keys = [part] if part else []
    e = edges.where("src is not null and dst is not null").select(*keys, "src", "dst")
    if not directed:
        e = e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = saved(e.where("src <> dst").distinct())
    delta = e if seeds is None else e.join(seeds.select(*keys, "src").distinct(), [*keys, "src"], "left_semi")
    step = e.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("next"))
    delta = saved(delta.withColumn("depth", F.lit(1)))
    layers = [delta]  # each round is written once; the known pairs are their union
    for depth in range(2, max_depth + 1) if max_depth else count(2):  # paths are finite, so a delta is empty in the end
        more = delta.select(*keys, "src", "dst").join(step, [*keys, "dst"]).select(*keys, "src", F.col("next").alias("dst"))
        known = reduce(DataFrame.unionByName, layers).select(*keys, "src", "dst")
        more = more.where("src <> dst").distinct().join(known, [*keys, "src", "dst"], "left_anti")
        delta = saved(more.withColumn("depth", F.lit(depth)))
        if delta.isEmpty():
            break
        layers.append(delta)
    known = reduce(DataFrame.unionByName, layers)
    if reflexive:
        nodes = e.select(*keys, "src").unionByName(e.select(*keys, F.col("dst").alias("src"))).distinct()
        known = known.unionByName(nodes.select(*keys, "src", F.col("src").alias("dst"), F.lit(0).alias("depth")))
    return known


def components(edges: DataFrame, part: str | None = None) -> DataFrame:
    """(part, node, comp): smallest node of each connected component.

    Labels are lowered along edges and their own labels' edges in turn (pointer jumping),
    so the rounds grow with the logarithm of a path's length, not with its length.
    """
    keys = [part] if part else []
    e = edges.where("src is not null and dst is not null").select(*keys, "src", "dst")
    both = saved(e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    lab = saved(both.groupBy(*keys, "src").agg(F.least(F.min("dst"), F.col("src")).alias("comp")).withColumnRenamed("src", "node"))
    while True:
        seen = both.join(lab.select(*keys, F.col("node").alias("dst"), "comp"), [*keys, "dst"])
        low = seen.groupBy(*keys, F.col("src").alias("node")).agg(F.min("comp").alias("low"))
        near = lab.join(low, [*keys, "node"]).select(*keys, "node", F.least("comp", "low").alias("comp"), F.col("comp").alias("was"))
        up = lab.select(*keys, F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = saved(near.join(up, [*keys, "comp"], "left").select(*keys, "node", F.least("comp", F.coalesce("top", "comp")).alias("comp"), "was"))
        changed = not new.where("comp <> was").isEmpty()
        lab = new.drop("was")
        if not changed:
            return lab
