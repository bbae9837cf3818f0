"""Planning over traces: grounding by joins, relaxed costs by iteration, search per scene."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import saved
from ..operators.closure import closure
from ..operators.fixpoint import Derivation, Relation
from ..operators.rules import And, Entity, Matcher, Rel, Same, Var, flat, variables
from ..operators.state import TraceState


@dataclass(frozen=True)
class Action:
    """Roles with types; preconditions, additions and deletions are (relation, role, role)."""

    name: str
    roles: dict[str, str | None]
    pre: tuple[tuple[str, str, str], ...] = ()
    add: tuple[tuple[str, str, str], ...] = ()
    delete: tuple[tuple[str, str, str], ...] = ()
    cost: int = 1
    distinct: bool = True

    __hash__ = object.__hash__


def fact(rel: str, a, b):
    return F.concat_ws("|", F.lit(rel), a, b)


def ground(state: TraceState, actions: list[Action], resolver: Callable[[TraceState], TraceState] | None = None) -> DataFrame:
    """(trace_id, action, binding, pre, add, del, cost): actions whose roles can be filled.

    Evidence first: relation preconditions are joined before role types, so roles are
    enumerated freely only where nothing ties them to the scene.  A ``resolver`` may bring
    further entities into the scenes before.
    """
    m = Matcher(resolver(state) if resolver else state)
    out = None
    for a in actions:
        parts: list = [Rel(r, Var(x), Var(y)) for r, x, y in a.pre] + [Entity(Var(r), type=t) for r, t in a.roles.items()]
        names = sorted(a.roles)
        if a.distinct:
            parts += [Same(Var(x), Var(y), equal=False) for i, x in enumerate(names) for y in names[i + 1 :]]
        b = m.body(And(tuple(parts))).select("trace_id", *names).distinct()
        facts = lambda fs: F.array(*[fact(r, F.col(x), F.col(y)) for r, x, y in fs]) if fs else F.array().cast("array<string>")
        g = b.select("trace_id", F.lit(a.name).alias("action"), F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names]).alias("binding"), facts(a.pre).alias("pre"), facts(a.add).alias("add"), facts(a.delete).alias("del"), F.lit(a.cost).alias("cost"))
        out = g if out is None else out.unionByName(g)
    return out


def ground_derivations(state: TraceState, rules: list[Derivation]) -> DataFrame:
    """(trace_id, action, binding, pre, add): every binding of a derivation as an action that
    costs nothing: its relations are preconditions, its relations derived are effects."""
    m = Matcher(state)
    out = None
    for r in rules:
        parts = [c for c in flat(r.when) if isinstance(c, Rel)]
        names = sorted(variables(r.when))
        b = m.body(r.when).select("trace_id", *names).distinct()
        term = lambda v: F.col(v.name) if isinstance(v, Var) else F.lit(v).cast("string")
        facts = lambda cs: F.array(*[fact(c.name, term(c.a0), term(c.a1)) for c in cs]) if cs else F.array().cast("array<string>")
        g = b.select("trace_id", F.lit(r.name).alias("action"), F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names]).alias("binding"), facts(parts).alias("pre"), facts([h for h in r.then if isinstance(h, Relation)]).alias("add"))
        out = g if out is None else out.unionByName(g)
    return out


def relaxed_costs(start: DataFrame, actions: DataFrame) -> DataFrame:
    """(trace_id, fact, cost): cheapest cost of each fact when deletions are ignored and the
    costs of preconditions add up.

    Only actions with a precondition whose cost fell in the last round give new costs; costs
    are whole numbers that only fall, so the loop ends when none does."""
    acts = saved(actions.withColumn("aid", F.concat_ws(":", "action", "binding")))
    need = saved(acts.select("trace_id", "aid", F.size("pre").alias("n"), "cost", F.explode_outer("pre").alias("fact")))
    gives = saved(acts.select("trace_id", "aid", F.explode("add").alias("fact")))
    cost = saved(start.select("trace_id", "fact").distinct().select("trace_id", "fact", F.lit(0).cast("long").alias("cost"), F.lit(True).alias("fell")))
    first = True
    while True:
        met = need.join(cost.select("trace_id", "fact", F.col("cost").alias("c"), "fell"), ["trace_id", "fact"], "left")
        met = met.groupBy("trace_id", "aid", "n", "cost").agg(F.sum("c").alias("s"), F.count("c").alias("k"), F.coalesce(F.max("fell"), F.lit(first)).alias("stirred"))
        ready = met.where("k = n and stirred").select("trace_id", "aid", (F.coalesce("s", F.lit(0)) + F.col("cost")).alias("c"))
        new = gives.join(ready, ["trace_id", "aid"]).groupBy("trace_id", "fact").agg(F.min("c").alias("c"))
        both = cost.select("trace_id", "fact", "cost").join(new, ["trace_id", "fact"], "full_outer")
        cost = saved(both.select("trace_id", "fact", F.least("cost", "c").alias("cost"), F.coalesce(F.col("c") < F.col("cost"), F.col("cost").isNull()).alias("fell")))
        first = False
        if cost.where("fell").isEmpty():
            return cost.drop("fell")


def goal_relevance(events: DataFrame, causes: DataFrame) -> DataFrame:
    """(goal, action): actions from which a chain of causes leads to the goal action.

    The backward walk goes over the kinds of actions that were seen to cause each other, a
    small graph however many traces there are."""
    e = events.select("trace_id", "event_id", "action").distinct()
    by = causes.join(e.select("trace_id", F.col("event_id").alias("cause"), F.col("action").alias("dst")), ["trace_id", "cause"])
    pairs = by.join(e.select("trace_id", "event_id", F.col("action").alias("src")), ["trace_id", "event_id"]).select("src", "dst").distinct()
    return closure(pairs).select(F.col("src").alias("goal"), F.col("dst").alias("action"))


def estimate(at: frozenset, ops: list[tuple], goal: str) -> int | None:
    """Layers of relaxed actions until the goal is reached; None where it never is."""
    known, layer = set(at), 0
    while goal not in known:
        new = set().union(*[add for _, pre, add, _ in ops if pre <= known]) - known
        if not new:
            return None
        known |= new
        layer += 1
    return layer


def search(start: DataFrame, actions: DataFrame, goals: DataFrame, max_states: int = 5000) -> DataFrame:
    """(trace_id, goal, found, n_steps, plan): shortest plans by A* in each trace by itself.

    The estimate of a state is the relaxed cost of the goal (deletions ignored, the dearest
    precondition counts), which never exceeds the true one, so plans are shortest; a state
    from which even the relaxed goal is out of reach is not followed.  One scene is small by
    nature (its entities); scenes are spread over tasks by trace.  ``found`` is null where
    ``max_states`` ended a search that was not over.
    """

    def one(key, facts: pd.DataFrame, acts: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        first = frozenset(facts["fact"])
        ops = [(f"{a}({b})", frozenset(p), frozenset(x), frozenset(y)) for a, b, p, x, y in zip(acts["action"], acts["binding"], acts["pre"], acts["add"], acts["del"], strict=True)]
        rows = []
        for goal in sorted(set(wants["goal"])):
            heap, best, found = [], {first: 0}, None
            tick = 0
            if (h := estimate(first, ops, goal)) is not None:
                heap.append((h, 0, 0, first, ()))
            while heap and len(best) <= max_states:
                _, _, n, at, plan = heapq.heappop(heap)
                if goal in at:
                    found = plan
                    break
                if n > best[at]:
                    continue
                for name, pre, add, gone in ops:
                    if pre <= at and best.get(nxt := (at - gone) | add, n + 2) > n + 1:
                        best[nxt] = n + 1
                        if (h := estimate(nxt, ops, goal)) is not None:
                            tick += 1
                            heapq.heappush(heap, (n + 1 + h, tick, n + 1, nxt, (*plan, name)))
            over = found is not None or not heap
            rows.append((key[0], goal, found is not None if over else None, len(found or ()), list(found or ())))
        return pd.DataFrame(rows, columns=["trace_id", "goal", "found", "n_steps", "plan"])

    tagged = start.select("trace_id", F.lit(0).alias("kind"), "fact", F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("binding"), F.array().cast("array<string>").alias("pre"), F.array().cast("array<string>").alias("add"), F.array().cast("array<string>").alias("del"))
    acts = actions.select("trace_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("fact"), "action", "binding", "pre", "add", "del")
    want = goals.select("trace_id", F.lit(2).alias("kind"), F.col("goal").alias("fact"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("binding"), F.array().cast("array<string>").alias("pre"), F.array().cast("array<string>").alias("add"), F.array().cast("array<string>").alias("del"))

    def scene(key, pdf: pd.DataFrame) -> pd.DataFrame:
        goals_ = pdf[pdf.kind == 2].rename(columns={"fact": "goal"})
        return one(key, pdf[pdf.kind == 0], pdf[pdf.kind == 1], goals_)

    return tagged.unionByName(acts).unionByName(want).groupBy("trace_id").applyInPandas(scene, "trace_id long, goal string, found boolean, n_steps int, plan array<string>")

