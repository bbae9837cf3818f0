"""Scenes: a small builder, placement by containment facts, and spawning of what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.state import Catalog, TraceState, empty_state


class Scene:
    """Rows of one or several scenes, put down step by step.

    ``Scene().place("kitchen").person("cook", at="kitchen").thing("knife", "artifact", on=("en", "kitchen"))``
    names entities by their concept; a second one of a concept gets a number.
    """

    def __init__(self, trace_id: int = 1) -> None:
        self.trace_id = trace_id
        self.entities: list[tuple] = []
        self.relations: list[tuple] = []
        self.props: list[tuple] = []

    def thing(self, concept: str, etype: str, on: tuple[str, str] | None = None, **slots: str) -> Scene:
        same = sum(e[2] == concept for e in self.entities)
        eid = f"{concept}{same}" if same else concept
        self.entities.append((self.trace_id, eid, concept, etype, None, None))
        self.props += [(self.trace_id, eid, k, v) for k, v in slots.items()]
        if on is not None:
            if on[1] not in {e[1] for e in self.entities}:
                raise ValueError(f"{on[1]} is not in the scene yet")
            self.relations.append((self.trace_id, on[0], eid, on[1]))
        return self

    def place(self, concept: str, **slots: str) -> Scene:
        return self.thing(concept, "location", **slots)

    def person(self, concept: str, at: str | None = None, **slots: str) -> Scene:
        return self.thing(concept, "person", ("en", at) if at else None, **slots)

    def scatter(self, concept: str, etype: str, n: int, at: str) -> Scene:
        for _ in range(n):
            self.thing(concept, etype, ("en", at))
        return self

    def owns(self, holder: str, thing: str) -> Scene:
        self.relations.append((self.trace_id, "havi", thing, holder))
        return self

    def build(self, spark: SparkSession, catalog: Catalog | None = None) -> TraceState:
        return empty_state(spark, catalog, entities=self.entities, relations=self.relations, props=self.props)


def unplaced(state: TraceState, relations: tuple[str, ...] = ("en", "sur")) -> DataFrame:
    """(trace_id, eid, concept): things and persons that stand in no place relation."""
    placed = state.relations.where(F.col("relation").isin(*relations)).select("trace_id", F.col("a0").alias("eid")).distinct()
    return state.entities.where("etype is null or etype <> 'location'").select("trace_id", "eid", "concept").join(placed, ["trace_id", "eid"], "left_anti")


def placements(state: TraceState, facts: DataFrame) -> DataFrame:
    """(trace_id, eid, relation, container): where the containment facts put what stands nowhere.

    Among the entities of the scene the first fact that applies decides, then the smallest id."""
    f = facts.select(F.col("contained").alias("concept"), F.col("container").alias("box"), "relation", "ord")
    boxes = state.entities.select("trace_id", F.col("eid").alias("container"), F.col("concept").alias("box"))
    j = unplaced(state).join(f, "concept").join(boxes, ["trace_id", "box"]).where("container <> eid")
    best = j.groupBy("trace_id", "eid").agg(F.min(F.struct("ord", "container", "relation")).alias("m"))
    return best.select("trace_id", "eid", "m.relation", "m.container")


def spawned(state: TraceState, facts: DataFrame, budget: int = 6) -> DataFrame:
    """(trace_id, concept, eid): containers to bring into scenes where a thing has none to stand in.

    Each thing wants the container of its first fact; a scene gets at most ``budget`` of
    them, those that most things want first (the budget is the feature)."""
    f = facts.groupBy(F.col("contained").alias("concept")).agg(F.min(F.struct("ord", "container")).alias("m")).select("concept", F.col("m.container").alias("want"))
    homeless = unplaced(state).join(placements(state, facts).select("trace_id", "eid"), ["trace_id", "eid"], "left_anti")
    n = homeless.join(f, "concept").groupBy("trace_id", "want").agg(F.count("*").alias("n"))
    w = W.partitionBy("trace_id").orderBy(F.desc("n"), "want")
    top = n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= budget)
    return top.select("trace_id", F.col("want").alias("concept"), F.concat(F.col("want"), F.lit("_nova")).alias("eid"))


def recipes(state: TraceState) -> DataFrame:
    """(action, role, type, n): the type that most often fills each role of an action."""
    e = state.entities.select("trace_id", F.col("eid").alias("value"), F.coalesce("etype", F.lit("?")).alias("type"))
    r = state.events.select("trace_id", "event_id", "action").join(state.roles, ["trace_id", "event_id"]).join(e, ["trace_id", "value"])
    n = r.groupBy("action", "role", "type").agg(F.count("*").alias("n"))
    return n.groupBy("action", "role").agg(F.max(F.struct("n", "type")).alias("m")).select("action", "role", "m.type", "m.n")


def moves(state: TraceState, weights: dict[str, float], temperature: float, draw: str) -> DataFrame:
    """(trace_id, move): a move of each scene drawn by softmax over weighted features.

    A move takes a thing along one of its relations; features are whether the thing is a
    person, how many relations it has, and whether it was the theme of an event."""
    from ..operators.sampling import softmax_pick

    deg = state.relations.select("trace_id", F.explode(F.array("a0", "a1")).alias("a0")).groupBy("trace_id", "a0").agg(F.count("*").alias("degree"))
    theme = state.roles.where("role = 'theme'").select("trace_id", F.col("value").alias("a0")).distinct().withColumn("told", F.lit(1))
    kind = state.entities.select("trace_id", F.col("eid").alias("a0"), F.coalesce((F.col("etype") == "person").cast("int"), F.lit(0)).alias("person"))
    m = state.relations.join(deg, ["trace_id", "a0"]).join(kind, ["trace_id", "a0"]).join(theme, ["trace_id", "a0"], "left")
    score = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()), F.lit(0.0))
    m = m.select("trace_id", F.concat_ws("|", F.col("trace_id").cast("string"), "relation", "a0", "a1").alias("move"), score.alias("score"))
    return softmax_pick(m, "trace_id", "move", F.col("score"), temperature, draw)
