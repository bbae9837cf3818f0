"""Declarative predicates: JSON patterns, preconditions of seven kinds, preferences."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import OPS
from .state import Catalog


def json_predicate(p: dict[str, Any], catalog: Catalog, etype: str = "etype", concept: str = "concept", props: str = "props") -> Column:
    """Boolean column of a JSON pattern: ``entity``, ``not``, ``and``, ``or``.

    ``props`` is a map from slot to list of values; only stored (asserted) values count.
    """
    if len(p) != 1:
        raise ValueError(f"one operator expected: {sorted(p)}")
    (op, arg), = p.items()
    sub = lambda x: json_predicate(x, catalog, etype, concept, props)
    if op == "not":
        return ~sub(arg)
    if op == "and":
        return reduce(lambda a, b: a & b, map(sub, arg), F.lit(True))
    if op == "or":
        return reduce(lambda a, b: a | b, map(sub, arg), F.lit(False))
    if op != "entity":
        raise ValueError(f"unknown operator {op}")
    out = F.lit(True)
    for key, want in arg.items():
        values = want if isinstance(want, list) else [want]
        if key == "type":
            c = F.col(etype).isin(*[t for v in values for t in catalog.subtypes(v)])
        elif key == "concept":
            c = F.col(concept).isin(*values)
        elif key == "category":
            c = F.col(concept).isin(*[m for v in values for m in catalog.members(v)])
        elif key == "has_suffix":
            c = reduce(lambda a, b: a | b, [F.col(concept).endswith(v) for v in values], F.lit(False))
        else:
            have = F.try_element_at(props, F.lit(key))
            c = F.size(F.array_intersect(F.coalesce(have, F.array().cast("array<string>")), F.array(*[F.lit(v) for v in values]).cast("array<string>"))) > 0
        out = out & F.coalesce(c, F.lit(False))
    return out


# ---------------------------------------------------------------- preconditions


def precondition(bindings: DataFrame, kind: str, spec: dict[str, Any], props: DataFrame, relations: DataFrame) -> DataFrame:
    """(bid, ok) for one precondition over bindings (trace_id, bid, role columns).

    Kinds: ``relation``, ``not_relation`` (name, a0, a1 roles); ``has_property``,
    ``not_property`` (role, slot, value); ``if_property`` (role, slot, value, then: role,
    slot, value; holds vacuously where the condition does not); ``match`` (the values of
    ``slot_a`` of role a and of ``slot_b`` of role b, or of one ``slot``, have one in common;
    a side without a value never matches); ``or`` (any of a list).

    A role that is null is unbound: the kinds that forbid something, ``relation`` and
    ``if_property`` hold vacuously, ``has_property`` and ``match`` fail.
    """
    if kind == "or":
        parts = [precondition(bindings, k, s, props, relations) for k, s in spec["any"]]
        return reduce(DataFrame.unionByName, parts).groupBy("bid").agg(F.max("ok").alias("ok"))
    if kind in ("relation", "not_relation"):
        r = relations.where(F.col("relation") == spec["name"]).select("trace_id", F.col("a0").alias(spec["a0"]), F.col("a1").alias(spec["a1"]), F.lit(True).alias("hit")).distinct()
        j = bindings.join(r, ["trace_id", spec["a0"], spec["a1"]], "left")
        hit = F.coalesce("hit", F.lit(False))
        unbound = F.col(spec["a0"]).isNull() | F.col(spec["a1"]).isNull()
        return j.select("bid", (unbound | (hit if kind == "relation" else ~hit)).alias("ok"))
    has = lambda b, role, slot, value, name: b.join(props.where((F.col("slot") == slot) & (F.col("value") == value)).select("trace_id", F.col("eid").alias(role), F.lit(True).alias(name)).distinct(), ["trace_id", role], "left")
    if kind in ("has_property", "not_property"):
        j = has(bindings, spec["role"], spec["slot"], spec["value"], "hit")
        hit = F.coalesce("hit", F.lit(False))
        return j.select("bid", (hit if kind == "has_property" else ~hit).alias("ok"))
    if kind == "if_property":
        j = has(bindings, spec["role"], spec["slot"], spec["value"], "cond")
        then = spec["then"]
        j = has(j, then["role"], then["slot"], then["value"], "hit")
        return j.select("bid", (F.col("cond").isNull() | F.coalesce("hit", F.lit(False))).alias("ok"))
    if kind == "match":
        side = lambda slot, role: props.where(F.col("slot") == slot).select("trace_id", F.col("eid").alias(role), "value").distinct()
        both = bindings.select("bid", "trace_id", spec["a"], spec["b"]).join(side(spec.get("slot_a", spec.get("slot")), spec["a"]), ["trace_id", spec["a"]])
        both = both.join(side(spec.get("slot_b", spec.get("slot")), spec["b"]), ["trace_id", spec["b"], "value"]).select("bid", F.lit(True).alias("hit")).distinct()
        return bindings.select("bid").join(both, "bid", "left").select("bid", F.coalesce("hit", F.lit(False)).alias("ok"))
    raise ValueError(f"unknown precondition {kind}")


def permitted(bindings: DataFrame, specs: list[tuple[str, dict]], props: DataFrame, relations: DataFrame) -> DataFrame:
    """Bindings for which every precondition holds."""
    out = bindings
    for kind, spec in specs:
        ok = precondition(bindings, kind, spec, props, relations).where("ok").select("bid")
        out = out.join(ok, "bid", "left_semi")
    return out


# ---------------------------------------------------------------- preferences


def displeased(props: DataFrame, prefs: DataFrame) -> DataFrame:
    """(trace_id, eid, slot, value, wanted): slots whose value is not the preferred one.

    ``prefs`` is (slot, wanted), a small dimension."""
    return props.join(prefs, "slot").where(F.col("value") != F.col("wanted")).select("trace_id", "eid", "slot", "value", "wanted")


def context_preferences(prefs: DataFrame, flipped: dict[str, str], active: Column) -> DataFrame:
    """Preferences with some slots flipped where a world condition is active (e.g. at night)."""
    if not flipped:
        return prefs
    other = F.create_map(*[F.lit(x) for kv in flipped.items() for x in kv])
    return prefs.withColumn("wanted", F.when(active, F.coalesce(F.try_element_at(other, F.col("slot")), F.col("wanted"))).otherwise(F.col("wanted")))


def role_matches(concepts: DataFrame, props: DataFrame, slot_flags: DataFrame, etype: list[str], wanted: dict[str, str]) -> DataFrame:
    """(owner): concepts that can fill a role of a type with wanted slot values.

    A slot that varies, holds for everything or can be derived (``slot_flags``: slot,
    loose) does not rule a concept out by its stored value; the others must have it.
    """
    out = concepts.where(F.col("etype").isin(*etype)).select("owner").distinct()
    for slot, value in wanted.items():
        loose = slot_flags.where((F.col("slot") == slot) & F.col("loose")).select(F.lit(True).alias("free")).limit(1)  # one row of a fixed dimension
        hit = props.where((F.col("slot") == slot) & (F.col("value") == value)).select("owner", F.lit(True).alias("hit")).distinct()
        out = out.join(hit, "owner", "left").join(loose, F.lit(True), "left").where(F.coalesce("hit", "free", F.lit(False))).select("owner")
    return out


def emitted_by_world(entities: DataFrame, value: str, verbs: dict[str, str], location: str, unmarked: str) -> DataFrame:
    """(trace_id, eid, action): a broadcast world state becomes an event at every location;
    nothing for the unmarked state or one without a verb."""
    if value == unmarked or value not in verbs:
        return entities.select("trace_id", "eid", F.lit("").alias("action")).limit(0)
    return entities.where(F.col("etype") == location).select("trace_id", "eid", F.lit(verbs[value]).alias("action"))


def fact_delta(facts: DataFrame, adds: DataFrame, dels: DataFrame, scalar: list[str]) -> DataFrame:
    """State after a step: (facts − deletions − displaced scalar values) ∪ additions.

    Facts are (trace_id, subject, slot, value)."""
    key = ["trace_id", "subject", "slot", "value"]
    kept = facts.join(dels.select(*key), key, "left_anti")
    moved = adds.where(F.col("slot").isin(*scalar) if scalar else F.lit(False)).select("trace_id", "subject", "slot").distinct()
    kept = kept.join(moved, ["trace_id", "subject", "slot"], "left_anti")
    return kept.select(*key).unionByName(adds.select(*key)).distinct()


def compare_values(left: Column, op: str, right: Column, strict: bool = True) -> Column:
    """Numeric comparison of texts; a missing side fails (strict) or passes."""
    c = OPS[op](left.try_cast("double"), right.try_cast("double"))
    return F.coalesce(c, F.lit(not strict))


def allowed_effects(effects: DataFrame, entities: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Relation effects (trace_id, relation, a0, a1) none of whose arguments has a forbidden type.

    ``forbidden`` is (relation, pos, etype), a small dimension."""
    e = entities.select("trace_id", "eid", "etype")
    out = effects
    for pos, col in ((0, "a0"), (1, "a1")):
        f = forbidden.where(F.col("pos") == pos).select("relation", "etype")
        bad = e.join(f, "etype").select("trace_id", F.col("eid").alias(col), "relation").distinct()
        out = out.join(bad, ["trace_id", col, "relation"], "left_anti")
    return out.select("trace_id", "relation", "a0", "a1")


def reachable_goals(goals: DataFrame, roles: DataFrame, closure: DataFrame) -> DataFrame:
    """Goals (trace_id, relation, a0type, a1type) that some producer's role types allow.

    ``roles`` is (relation, t0, t1) of producers; ``closure`` is (type, ancestor), reflexive."""
    up = closure.select("type", "ancestor")
    g = goals.join(up.select(F.col("type").alias("a0type"), F.col("ancestor").alias("t0")), "a0type").join(up.select(F.col("type").alias("a1type"), F.col("ancestor").alias("t1")), "a1type")
    return g.join(roles, ["relation", "t0", "t1"]).select(*goals.columns).distinct()
