"""Event calculus: state at a position, lifetimes, causes, and content hashes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checkpoints import saved


def property_at(changes: DataFrame, initial: DataFrame, asks: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(trace_id, eid, slot, t, value): the last change before ``t``, else the initial value.

    ``asks`` has (trace_id, eid, slot, t).  An entity created at or after ``t`` has no
    value; destruction is ignored.  One sort per (trace, entity, slot): the questions and
    the changes are merged and the value is carried forward.
    """
    key = ["trace_id", "eid", "slot"]
    first = initial.groupBy(*key).agg(F.min("value").alias("value")).withColumn("t", F.lit(-1))
    facts = changes.select(*key, F.col("pos").alias("t"), "value").unionByName(first.select(*key, "t", "value")).withColumn("ask", F.lit(0))
    rows = facts.unionByName(asks.select(*key, "t", F.lit(None).cast("string").alias("value"), F.lit(1).alias("ask")))
    # at equal positions a question stands before the change: only earlier changes count
    w = W.partitionBy(*key).orderBy("t", F.desc("ask")).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("ask = 1").select(*key, "t", "value")
    if entities is not None:
        born = entities.select("trace_id", "eid", "created_at")
        out = out.join(born, ["trace_id", "eid"], "left")
        out = out.withColumn("value", F.when(F.coalesce(F.col("created_at") < F.col("t"), F.lit(True)), F.col("value"))).drop("created_at")
    return out


def entities_at(entities: DataFrame, t: int) -> DataFrame:
    """Entities that exist at position ``t``: created before it, not destroyed before it."""
    return entities.where(F.coalesce(F.col("created_at") < t, F.lit(True)) & F.coalesce(F.col("destroyed_at") >= t, F.lit(True)))


def _levels(events: DataFrame, what: str) -> Iterator[int]:
    """1, 2, … up to the events of the largest trace: a longer chain of causes would be a cycle."""
    most = events.groupBy("trace_id").agg(F.countDistinct("event_id").alias("n")).agg(F.max("n")).first()[0] or 0
    yield from range(1, most + 1)
    raise ValueError(f"{what}: causes form a cycle")


def causal_depth(events: DataFrame, causes: DataFrame) -> DataFrame:
    """(trace_id, event_id, depth): edges on the longest chain of causes that ends in the event.

    Causes come before effects; a cycle has no longest chain and raises."""
    nodes = events.select("trace_id", "event_id").distinct()
    edges = saved(causes.join(nodes, ["trace_id", "event_id"], "left_semi").join(nodes.withColumnRenamed("event_id", "cause"), ["trace_id", "cause"], "left_semi").distinct())
    best = saved(nodes.withColumn("depth", F.lit(0)))
    layer = best
    for d in _levels(nodes, "causal_depth"):
        layer = saved(edges.join(layer.select("trace_id", F.col("event_id").alias("cause")), ["trace_id", "cause"]).select("trace_id", "event_id").distinct().withColumn("depth", F.lit(d)))
        if layer.isEmpty():
            break
        best = saved(best.unionByName(layer).groupBy("trace_id", "event_id").agg(F.max("depth").alias("depth")))
    return best


def chain_paths(events: DataFrame, causes: DataFrame) -> DataFrame:
    """(depth, n_paths): number of causal paths of each length over all traces; a cycle raises."""
    edges = saved(causes.select("trace_id", "event_id", "cause").distinct())
    counts = edges.select("trace_id", "event_id").groupBy("trace_id", "event_id").agg(F.count("*").alias("n"))
    out = [counts.agg(F.lit(1).alias("depth"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_paths"))]
    layer = saved(counts)
    for d in _levels(edges, "chain_paths"):
        d += 1
        step = edges.join(layer.select("trace_id", F.col("event_id").alias("cause"), "n"), ["trace_id", "cause"])
        layer = saved(step.groupBy("trace_id", "event_id").agg(F.sum("n").alias("n")))
        if layer.isEmpty():
            break
        out.append(layer.agg(F.lit(d).alias("depth"), F.sum("n").alias("n_paths")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def rule_attribution(events: DataFrame, causes: DataFrame) -> DataFrame:
    """(action, inferred, n): seed events, or '<cause action> → <action>' for caused ones."""
    cause = events.select("trace_id", F.col("event_id").alias("cause"), F.col("action").alias("by"))
    one = causes.join(cause, ["trace_id", "cause"]).groupBy("trace_id", "event_id").agg(F.min("by").alias("by"))
    out = events.join(one, ["trace_id", "event_id"], "left")
    return out.groupBy("action", F.when(F.col("by").isNull(), F.lit("seed")).otherwise(F.concat_ws(" → ", "by", "action")).alias("inferred")).agg(F.count("*").alias("n"))


def reservoir(adds: DataFrame, uses: DataFrame, last: DataFrame, max_age: int) -> DataFrame:
    """(trace_id, item, pos, age): items still held at the end of each trace.

    ``adds`` and ``uses`` are (trace_id, item, pos); an item is held from its last addition,
    leaves with a later use, and is evicted when older than ``max_age`` positions.
    """
    a = adds.groupBy("trace_id", "item").agg(F.max("pos").alias("pos"))
    u = uses.groupBy("trace_id", "item").agg(F.max("pos").alias("used"))
    end = last.groupBy("trace_id").agg(F.max("pos").alias("end"))
    j = a.join(u, ["trace_id", "item"], "left").join(end, "trace_id")
    age = F.col("end") - F.col("pos")
    return j.where((F.col("used").isNull() | (F.col("used") < F.col("pos"))) & (age <= max_age)).select("trace_id", "item", "pos", age.alias("age"))
