"""Sentences from traces: set-up relations grouped by container, then one sentence for a run
of events with the same agent, the agent named once and then by pronoun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import accusative, capitalise_first, tense
from ..operators.sequences import islands
from ..operators.state import TraceState


def name(eid: Column) -> Column:
    """Readable name of an entity id (the number at its end is dropped)."""
    return F.concat(F.lit("la "), F.regexp_replace(eid, "[0-9]+$", ""))


def setting(state: TraceState) -> DataFrame:
    """(trace_id, seq, text): 'X kaj Y estas en Z.' for each container."""
    r = state.relations.where("relation in ('en', 'sur')")
    g = r.groupBy("trace_id", "relation", "a1").agg(F.array_join(F.array_sort(F.collect_list(name(F.col("a0")))), " kaj ").alias("who"))
    s = F.concat(capitalise_first(F.col("who")), F.lit(" estas "), F.col("relation"), F.lit(" "), name(F.col("a1")), F.lit("."))
    return g.select("trace_id", F.concat_ws("|", "relation", "a1").alias("seq"), s.alias("text"))


def events_text(state: TraceState) -> DataFrame:
    """(trace_id, island, text): one sentence for each run of events of one agent."""
    roles = state.roles.groupBy("trace_id", "event_id").agg(F.max(F.when(F.col("role") == "agent", F.col("value"))).alias("agent"), F.max(F.when(F.col("role") == "theme", F.col("value"))).alias("theme"))
    e = state.events.join(roles, ["trace_id", "event_id"], "left").withColumn("agent", F.coalesce("agent", F.lit("io")))
    i = islands(e, "trace_id", ["pos", "event_id"], "agent")
    clause = F.concat_ws(" ", tense(F.col("action"), "is"), F.when(F.col("theme").isNotNull(), accusative(name(F.col("theme")))))
    g = i.groupBy("trace_id", "island", "agent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id", clause.alias("c")))), lambda x: x["c"]), ", poste ").alias("c"))
    return g.select("trace_id", "island", F.concat(capitalise_first(name(F.col("agent"))), F.lit(" "), F.col("c"), F.lit(".")).alias("text"))


def prose(state: TraceState) -> DataFrame:
    """(trace_id, text): the setting, then the events in order."""
    a = setting(state).select("trace_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), "seq", "text")
    b = events_text(state).select("trace_id", F.lit(1).alias("part"), F.col("island").alias("k"), F.lit("").alias("seq"), "text")
    g = a.unionByName(b).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("part", "k", "seq", "text"))).alias("x"))
    return g.select("trace_id", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))


def messages(state: TraceState) -> DataFrame:
    """(trace_id, pos, kind, subject, text): events with their first cause, and entities that
    appear or vanish at an event's position."""
    roles = state.roles.groupBy("trace_id", "event_id").agg(F.max(F.when(F.col("role") == "agent", F.col("value"))).alias("agent"), F.max(F.when(F.col("role") == "theme", F.col("value"))).alias("theme"))
    e = state.events.join(roles, ["trace_id", "event_id"], "left").withColumn("agent", F.coalesce("agent", F.lit("io")))
    told = e.select("trace_id", F.col("event_id").alias("cause"), F.col("pos").alias("cpos"), F.concat_ws(" ", name(F.col("agent")), tense(F.col("action"), "is")).alias("said"))
    why = state.causes.distinct().join(told, ["trace_id", "cause"]).groupBy("trace_id", "event_id").agg(F.min_by("said", F.struct("cpos", "cause")).alias("said"))
    text = F.concat_ws(" ", capitalise_first(name(F.col("agent"))), tense(F.col("action"), "is"), F.when(F.col("theme").isNotNull(), accusative(name(F.col("theme")))))
    ev = e.join(why, ["trace_id", "event_id"], "left").select("trace_id", "pos", F.lit("event").alias("kind"), F.col("event_id").alias("subject"), F.concat(text, F.coalesce(F.concat(F.lit(", ĉar "), F.col("said")), F.lit("")), F.lit(".")).alias("text"))
    at = state.events.select("trace_id", "pos").distinct()
    life = lambda col, kind, verb: state.entities.where(F.col(col).isNotNull()).select("trace_id", F.col(col).alias("pos"), F.lit(kind).alias("kind"), F.col("eid").alias("subject"), F.concat(capitalise_first(name(F.col("eid"))), F.lit(f" {verb}.")).alias("text")).join(at, ["trace_id", "pos"], "left_semi")
    cols = ["trace_id", "pos", "kind", "subject", "text"]
    return ev.select(*cols).unionByName(life("created_at", "appears", "aperis").select(*cols)).unionByName(life("destroyed_at", "vanishes", "malaperis").select(*cols))
