"""Relation schema checks and containment over small rule dimensions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import saved
from .closure import closure
from .predicates import json_predicate
from .rules import OPS
from .state import Catalog


def relation_reasons(relations: DataFrame, entities: DataFrame, schema: dict[str, tuple], catalog: Catalog) -> DataFrame:
    """(…, reason): the first violated check of each tuple, null where it is permitted.

    Order of checks: known relation, both entities known, argument types, distinct arguments.
    """
    e = entities.select("trace_id", "eid", "etype")
    r = relations.join(e.select("trace_id", F.col("eid").alias("a0"), F.col("etype").alias("t0"), F.lit(True).alias("k0")), ["trace_id", "a0"], "left")
    r = r.join(e.select("trace_id", F.col("eid").alias("a1"), F.col("etype").alias("t1"), F.lit(True).alias("k1")), ["trace_id", "a1"], "left")
    reason = F.when(~F.col("relation").isin(*schema), "unknown relation").when(F.col("k0").isNull() | F.col("k1").isNull(), "unknown entity")
    for name, wants in schema.items():
        for col, want in zip(("t0", "t1"), wants, strict=True):
            if want is not None:
                bad = ~F.coalesce(F.col(col).isin(*catalog.subtypes(want)), F.lit(False))
                reason = reason.when((F.col("relation") == name) & bad, "argument type")
    reason = reason.when(F.col("a0") == F.col("a1"), "same argument")
    return r.select("trace_id", "relation", "a0", "a1", reason.alias("reason"))


@dataclass(frozen=True)
class RelationSchema:
    """What a relation asks of its arguments; every field but ``types`` may stay empty.

    ``kinds`` of an argument: entity, slot (a name of the catalog) or literal (anything);
    ``excludes``: forbidden subtypes by argument; ``not_part``: arguments that must not be a
    part of something; ``patterns``: JSON patterns by argument; ``compare``: (left argument,
    slot, operator, right argument, slot), vacuous where a number is missing.
    """

    types: tuple[str | None, ...]
    kinds: tuple[str, ...] = ()
    excludes: dict[int, tuple[str, ...]] = field(default_factory=dict)
    not_part: tuple[int, ...] = ()
    patterns: dict[int, dict[str, Any]] = field(default_factory=dict)
    compare: tuple[tuple[int, str, str, int, str], ...] = ()

    __hash__ = object.__hash__


def checked_relations(relations: DataFrame, entities: DataFrame, schemas: dict[str, RelationSchema], catalog: Catalog, slots: tuple[str, ...] = (), parts: DataFrame | None = None, allowed: DataFrame | None = None, contained: tuple[str, ...] = ()) -> DataFrame:
    """(trace_id, relation, args, reason): the first check a tuple fails, null where it is permitted.

    ``relations`` is (trace_id, relation, args); ``entities`` (trace_id, eid, concept, etype,
    props); ``parts`` (trace_id, eid) of entities that are parts; ``allowed`` (container,
    contained, relation, required) as ``containment_facts`` gives it, asked for the relations
    named in ``contained``.  Order of checks: relation, arity, kinds and types, excludes,
    part, pattern, comparison, required containment, containment.
    """
    out = relations.select("trace_id", "relation", "args").distinct()
    wide = max(len(s.types) for s in schemas.values())
    e = entities.select("trace_id", "eid", "concept", "etype", "props")
    for i in range(wide):
        out = out.withColumn(f"a{i}", F.get("args", F.lit(i)))
        out = out.join(e.select("trace_id", F.col("eid").alias(f"a{i}"), F.col("concept").alias(f"c{i}"), F.col("etype").alias(f"t{i}"), F.col("props").alias(f"p{i}"), F.lit(True).alias(f"k{i}")), ["trace_id", f"a{i}"], "left")
        if parts is not None:
            out = out.join(parts.select("trace_id", F.col("eid").alias(f"a{i}")).distinct().withColumn(f"part{i}", F.lit(True)), ["trace_id", f"a{i}"], "left")
    of = lambda i, types: F.coalesce(F.col(f"t{i}").isin(*[t for x in types for t in catalog.subtypes(x)]), F.lit(False))
    number = lambda i, slot: F.get(F.try_element_at(f"p{i}", F.lit(slot)), F.lit(0)).try_cast("double")
    reason = F.when(~F.col("relation").isin(*schemas), "unknown relation")
    for step in ("arity", "kind", "type", "excluded", "part", "pattern", "compare"):
        for name, s in schemas.items():
            kinds = s.kinds or ("entity",) * len(s.types)
            bad: list[Column] = []
            if step == "arity":
                bad = [F.size("args") != len(s.types)]
            for i, k in enumerate(kinds):
                if step == "kind":
                    bad += [~F.col(f"a{i}").isin(*slots) if slots else F.lit(True)] if k == "slot" else [F.col(f"k{i}").isNull()] if k == "entity" else []
                elif k != "entity":
                    continue
                elif step == "type" and s.types[i] is not None:
                    bad.append(~of(i, [s.types[i]]))
                elif step == "excluded" and s.excludes.get(i):
                    bad.append(of(i, s.excludes[i]))
                elif step == "part" and i in s.not_part and parts is not None:
                    bad.append(F.col(f"part{i}").isNotNull())
                elif step == "pattern" and i in s.patterns:
                    bad.append(~json_predicate(s.patterns[i], catalog, f"t{i}", f"c{i}", f"p{i}"))
            if step == "compare":
                bad = [~F.coalesce(OPS[op](number(i, x), number(j, y)), F.lit(True)) for i, x, op, j, y in s.compare]
            if bad:
                reason = reason.when((F.col("relation") == name) & reduce(lambda x, y: x | y, bad), step)
    if allowed is not None and contained:
        f = allowed.groupBy(F.col("contained").alias("c0"), F.col("container").alias("c1"), F.col("relation").alias("relation")).agg(F.lit(True).alias("declared"))
        must = allowed.where("required").groupBy(F.col("contained").alias("c0")).agg(F.collect_set("relation").alias("must"), F.collect_set("container").alias("where"))
        out = out.join(f, ["c0", "c1", "relation"], "left").join(must, "c0", "left")
        asked = F.col("relation").isin(*contained)
        reason = reason.when(asked & F.col("must").isNotNull() & ~(F.array_contains("must", F.col("relation")) & F.array_contains("where", F.col("c1"))), "required")
        reason = reason.when(asked & F.col("declared").isNull(), "containment")
    return out.select("trace_id", "relation", "args", reason.alias("reason"))


def containment_facts(concepts: DataFrame, facts: list[dict[str, Any]], catalog: Catalog) -> DataFrame:
    """(container, contained, relation, required, ord): declared facts over the concepts they match.

    ``concepts`` is (concept, etype, props), the catalog.  A fact has ``relation``, a
    ``container`` and a ``contained`` side -- each a JSON pattern, whose fields must all
    match -- and may have ``contains``: a concept that the container must reach by the facts
    without that condition (second order, looked up once).  A fact with an empty side or an
    unknown field is an error when it is read.
    """
    known = {"relation", "container", "contained", "contains", "required"}
    for f in facts:
        if not {"relation", "container", "contained"} <= set(f) or set(f) - known:
            raise ValueError(f"containment fact with missing or unknown fields: {sorted(f)}")
        if not f["container"] or not f["contained"]:
            raise ValueError("containment fact with an empty pattern")
    c = saved(concepts.select("concept", "etype", "props").dropDuplicates(["concept"]))
    # each fact tags the concepts of its two sides; tags of one fact make its pairs
    tag = lambda f, i, side: c.where(json_predicate(f[side], catalog)).select(F.col("concept").alias(side), F.lit(f["relation"]).alias("relation"), F.lit(bool(f.get("required"))).alias("required"), F.lit(i).alias("ord"))
    whole = lambda side, some: reduce(DataFrame.unionByName, [tag(facts[i], i, side) for i in some])
    first = [i for i, f in enumerate(facts) if "contains" not in f]
    second = [i for i in range(len(facts)) if i not in first]
    cols = ["container", "contained", "relation", "required", "ord"]
    paired = lambda boxes, some: boxes.join(whole("contained", some).select("contained", "ord"), "ord").select(*cols)
    out = paired(whole("container", first), first) if first else c.sparkSession.createDataFrame([], "container string, contained string, relation string, required boolean, ord int")
    if second:
        out = saved(out)
        reach = closure(out.select(F.col("container").alias("src"), F.col("contained").alias("dst"))).select(F.col("src").alias("container"), F.col("dst").alias("contains"))
        wants = reduce(lambda x, i: x.when(F.col("ord") == i, facts[i]["contains"]), second, F.when(F.lit(False), None))
        boxes = whole("container", second).withColumn("contains", wants).join(reach, ["container", "contains"], "left_semi")
        out = out.unionByName(paired(boxes, second))
    return out


def reachable_concepts(facts: DataFrame, scene: str) -> DataFrame:
    """(concept): what a scene holds, at any depth, the scene itself included."""
    e = facts.select(F.col("container").alias("src"), F.col("contained").alias("dst"))
    seed = facts.sparkSession.createDataFrame([(scene,)], "src string")
    return closure(e, seeds=seed).select(F.col("dst").alias("concept")).unionByName(seed.select(F.col("src").alias("concept"))).distinct()


def numeric_gate(relations: DataFrame, values: DataFrame, op: str) -> DataFrame:
    """Tuples whose arguments' numbers compare; a missing or non-numeric side passes."""
    v = values.select("trace_id", "eid", F.expr("try_cast(value as double)").alias("v"))
    r = relations.join(v.select("trace_id", F.col("eid").alias("a0"), F.col("v").alias("l")), ["trace_id", "a0"], "left")
    r = r.join(v.select("trace_id", F.col("eid").alias("a1"), F.col("v").alias("r")), ["trace_id", "a1"], "left")
    return r.where(F.coalesce(OPS[op](F.col("l"), F.col("r")), F.lit(True))).select("trace_id", "relation", "a0", "a1")


def containment_pairs(concepts: DataFrame, facts: list[tuple[int, str, str, str]]) -> DataFrame:
    """(container, contained, relation, ord): type-level containment facts over concepts.

    The facts are a fixed, small dimension; concepts join them on their type.
    """
    f = concepts.sparkSession.createDataFrame(facts, "ord int, tc string, tp string, relation string")
    a = concepts.select(F.col("concept").alias("container"), F.col("entity_type").alias("tc"))
    b = concepts.select(F.col("concept").alias("contained"), F.col("entity_type").alias("tp"))
    return a.join(f, "tc").join(b, "tp").select("container", "contained", "relation", "ord")


def inverse_containment(pairs: DataFrame) -> DataFrame:
    """(contained, container, relation): the first fact for each pair."""
    return pairs.groupBy("contained", "container").agg(F.min_by("relation", "ord").alias("relation"))


def required_violation(needed: DataFrame, relations: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(trace_id, eid, violated): entities that must stand in one of the relations."""
    ok = relations.where(F.col("relation").isin(*names)).select("trace_id", F.col("a0").alias("eid")).distinct().withColumn("ok", F.lit(True))
    return needed.select("trace_id", "eid").distinct().join(ok, ["trace_id", "eid"], "left").select("trace_id", "eid", F.col("ok").isNull().alias("violated"))


def container_chain(relations: DataFrame) -> DataFrame:
    """(trace_id, eid, up, depth): containers met walking up the first parent of each step.

    A walk ends at the top or before it meets a container again, so the loop ends."""
    first = saved(relations.where("a0 <> a1").groupBy("trace_id", "a0").agg(F.min("a1").alias("a1")))
    layer = first.select("trace_id", F.col("a0").alias("eid"), F.col("a1").alias("up"), F.lit(1).alias("depth"), F.array("a0", "a1").alias("seen"))
    layer = saved(layer)
    out = layer
    for depth in count(2):
        step = layer.join(first.select("trace_id", F.col("a0").alias("up"), F.col("a1").alias("nxt")), ["trace_id", "up"])
        step = step.where(~F.array_contains("seen", F.col("nxt")))
        layer = saved(step.select("trace_id", "eid", F.col("nxt").alias("up"), F.lit(depth).alias("depth"), F.array_append("seen", F.col("nxt")).alias("seen")))
        if layer.isEmpty():
            break
        out = out.unionByName(layer)
    return out.select("trace_id", "eid", "up", "depth")
