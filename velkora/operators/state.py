"""State of many independent traces as DataFrames; every table carries ``trace_id`` first.

Wide inputs (maps, arrays) become long rows once, so that every later match is an
equi-join or a filter.  Views over the state:

* ``current_props``  value of each slot after all events (last change, else initial)
* ``eff_prop``       asserted values, and derived ones where a scalar slot has none
* ``eff_rel``        asserted and derived tuples minus the removal mask (tested on the
  stored order), symmetric relations in both orders
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "trace_id long, eid string, concept string, etype string, created_at int, destroyed_at int"
PROP = "trace_id long, eid string, slot string, value string"
REL = "trace_id long, relation string, a0 string, a1 string"
EVENT = "trace_id long, pos int, event_id string, action string, quantity int"
ROLE = "trace_id long, event_id string, role string, ord int, value string"
CAUSE = "trace_id long, event_id string, cause string"
CHANGE = "trace_id long, pos int, eid string, slot string, value string"
CATEGORY = "trace_id long, eid string, category string"


@dataclass(frozen=True)
class Catalog:
    """Small fixed dimensions kept on the driver (their size does not grow with the data)."""

    types: dict[str, str | None] = field(default_factory=dict)  # child -> parent
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)  # concept -> parents
    symmetric: frozenset[str] = frozenset()
    multi_valued: frozenset[str] = frozenset()  # slots that accumulate; all others are scalar

    def subtypes(self, name: str) -> list[str]:
        """The type and everything below it; an unknown type has only itself."""
        found, todo = {name}, [name]
        while todo:
            at = todo.pop()
            for child, parent in self.types.items():
                if parent == at and child not in found:
                    found.add(child)
                    todo.append(child)
        return sorted(found)

    def members(self, category: str) -> list[str]:
        """Concepts that are a category reflexively and transitively; cycles are harmless."""
        found, todo = {category}, [category]
        while todo:
            at = todo.pop()
            for concept, parents in self.categories.items():
                if at in parents and concept not in found:
                    found.add(concept)
                    todo.append(concept)
        return sorted(found)


@dataclass(frozen=True)
class TraceState:
    entities: DataFrame
    props: DataFrame
    relations: DataFrame
    events: DataFrame
    roles: DataFrame
    causes: DataFrame
    changes: DataFrame
    catalog: Catalog = Catalog()
    d_props: DataFrame | None = None
    d_rels: DataFrame | None = None
    d_removals: DataFrame | None = None
    d_cats: DataFrame | None = None

    def with_(self, **kw) -> TraceState:
        return replace(self, **kw)

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def current_props(self) -> DataFrame:
        """(trace_id, eid, slot, value): last change of a slot wins over its initial values."""
        last = self.changes.groupBy("trace_id", "eid", "slot").agg(F.max_by("value", "pos").alias("value"))
        kept = self.props.join(last.select("trace_id", "eid", "slot"), ["trace_id", "eid", "slot"], "left_anti")
        return kept.unionByName(last)

    def eff_prop(self) -> DataFrame:
        now = self.current_props()
        if self.d_props is None:
            return now
        key = ["trace_id", "eid", "slot"]
        scalar = ~F.col("slot").isin(*self.catalog.multi_valued) if self.catalog.multi_valued else F.lit(True)
        free = self.d_props.where(scalar).join(now.select(*key), key, "left_anti")
        out = now.unionByName(free)
        if self.catalog.multi_valued:
            out = out.unionByName(self.d_props.where(~scalar)).distinct()
        return out

    def eff_rel(self) -> DataFrame:
        rel = self.relations if self.d_rels is None else self.relations.unionByName(self.d_rels)
        if self.d_removals is not None:
            rel = rel.join(self.d_removals, ["trace_id", "relation", "a0", "a1"], "left_anti")
        if self.catalog.symmetric:
            sym = rel.where(F.col("relation").isin(*self.catalog.symmetric) & (F.col("a0") != F.col("a1")))
            rel = rel.unionByName(sym.select("trace_id", "relation", F.col("a1").alias("a0"), F.col("a0").alias("a1")))
        return rel.distinct()


def load_state(spark: SparkSession, d: str, catalog: Catalog | None = None) -> TraceState:
    """State of the trace tables; repeated rows are one, null types and empty maps are kept."""
    e = spark.read.parquet(f"{d}/trace_entities.parquet")
    r = spark.read.parquet(f"{d}/trace_relations.parquet")
    v = spark.read.parquet(f"{d}/trace_events.parquet").dropDuplicates(["trace_id", "event_id", "pos"])
    entities = e.select("trace_id", "eid", "concept", F.col("entity_type").alias("etype"), "created_at", "destroyed_at")
    props = e.select("trace_id", "eid", F.explode("properties").alias("slot", "values")).select("trace_id", "eid", "slot", F.explode("values").alias("value"))
    relations = r.select("trace_id", "relation", F.get("args", F.lit(0)).alias("a0"), F.get("args", F.lit(1)).alias("a1")).distinct()
    roles = v.select("trace_id", "event_id", F.explode("roles").alias("role", "value")).select("trace_id", "event_id", "role", F.lit(0).alias("ord"), "value")
    causes = v.select("trace_id", "event_id", F.explode("caused_by").alias("cause"))
    events = v.select("trace_id", "pos", "event_id", "action", "quantity")
    changes = spark.createDataFrame([], CHANGE)
    return TraceState(entities, props, relations, events, roles, causes, changes, catalog or Catalog())


def empty_state(spark: SparkSession, catalog: Catalog | None = None, **tables: list[tuple]) -> TraceState:
    """State from small literal rows (fixtures); tables not given are empty."""
    schema = {"entities": ENTITY, "props": PROP, "relations": REL, "events": EVENT, "roles": ROLE, "causes": CAUSE, "changes": CHANGE}
    frames = {k: spark.createDataFrame(tables.get(k, []), s) for k, s in schema.items()}
    return TraceState(**frames, catalog=catalog or Catalog())
