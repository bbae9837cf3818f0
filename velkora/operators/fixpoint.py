"""Derivations to a fixpoint, and causal rules with effects.

``derive`` applies an ordered list of derivations to all traces at once until nothing is
new.  Derived rows only grow and are made of values that occur, so the loop ends; it
raises where a caller's ``max_rounds`` ends it before.  Asserted values win over derived ones; for a scalar
slot the first derivation in list order wins; the derived layer is rebuilt from asserted
state on every call, so conclusions vanish with their premises.

``run`` alternates derivation and causal rules.  A causal rule fires once for each
(rule, event, binding); the memo of fired bindings is kept across rounds.  Event ids are
content hashes, so emitting the same event twice changes nothing.  Rules that keep creating
new events for each other never end: after ``MAX_ROUNDS`` rounds ``run`` raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checkpoints import saved
from .rules import Clause, Event, Matcher, Var, check_safety
from .state import CATEGORY, PROP, REL, TraceState

MAX_ROUNDS = 50


# ---------------------------------------------------------------- heads


@dataclass(frozen=True)
class Property:
    eid: Var
    slot: str
    value: Any


@dataclass(frozen=True)
class Relation:
    name: str
    a0: Any
    a1: Any


@dataclass(frozen=True)
class NotRelation:
    name: str
    a0: Any
    a1: Any


@dataclass(frozen=True)
class Category:
    eid: Var
    category: str


#: The relation that says what is a part of what.
PART_OF = "parto de"


def Part(whole: Any, part: Any) -> Relation:  # noqa: N802 (a head like the others)
    """Head: ``part`` belongs to ``whole``."""
    return Relation(PART_OF, part, whole)


@dataclass(frozen=True)
class Derivation:
    name: str
    when: Clause
    then: tuple

    def __post_init__(self) -> None:
        check_safety(self.when, {x.name for h in self.then for x in vars(h).values() if isinstance(x, Var)})


def _col(x: Any) -> Column:
    return F.col(x.name) if isinstance(x, Var) else F.lit(x).cast("string")


_KIND = {"d_props": "slot", "d_rels": "relation", "d_removals": "relation", "d_cats": "category"}


class NoFixpoint(RuntimeError):
    """The bound on rounds was met while there was still something new."""


def derive(state: TraceState, rules: list[Derivation], max_rounds: int | None = None) -> TraceState:
    """State with its derived layers rebuilt.

    Dependency tags spare work: after the first round a rule is matched again only if the
    round before derived something of a name that it reads.
    """
    from .introspect import reads, writes

    spark = state.spark
    none = lambda s: spark.createDataFrame([], s)
    state = state.with_(d_props=none(PROP), d_rels=none(REL), d_removals=none(REL), d_cats=none(CATEGORY))
    asserted = saved(state.current_props())
    multi = state.catalog.multi_valued
    changed: set | None = None
    for done in count():
        if max_rounds is not None and done > max_rounds:
            raise NoFixpoint(f"still deriving after {max_rounds} rounds")
        m = Matcher(state)
        props, rels, gone, cats = [], [], [], []
        active = [(i, r) for i, r in enumerate(rules) if changed is None or reads(r.when) & changed]
        if not active:
            return state
        for order, rule in active:
            b = m.body(rule.when).distinct()
            for h in rule.then:
                match h:
                    case Property(eid, slot, value):
                        props.append(b.select("trace_id", _col(eid).alias("eid"), F.lit(slot).alias("slot"), _col(value).alias("value"), F.lit(order).alias("ord")))
                    case Relation(name, a0, a1):
                        rels.append(b.select("trace_id", F.lit(name).alias("relation"), _col(a0).alias("a0"), _col(a1).alias("a1")))
                    case NotRelation(name, a0, a1):
                        gone.append(b.select("trace_id", F.lit(name).alias("relation"), _col(a0).alias("a0"), _col(a1).alias("a1")))
                    case Category(eid, category):
                        cats.append(b.select("trace_id", _col(eid).alias("eid"), F.lit(category).alias("category")))
        new = {}
        if props:
            p = reduce(DataFrame.unionByName, props)
            scalar = ~F.col("slot").isin(*multi) if multi else F.lit(True)
            key = ["trace_id", "eid", "slot"]
            first = p.where(scalar).groupBy(*key).agg(F.min_by("value", F.struct("ord", "value")).alias("value"))
            fresh = first.join(asserted.select(*key), key, "left_anti").join(state.d_props.select(*key), key, "left_anti")
            if multi:
                have = asserted.unionByName(state.d_props)
                fresh = fresh.unionByName(p.where(~scalar).drop("ord").distinct().join(have, [*key, "value"], "left_anti"))
            new["d_props"] = fresh
        key = ["trace_id", "relation", "a0", "a1"]
        if rels:
            new["d_rels"] = reduce(DataFrame.unionByName, rels).distinct().join(state.relations.unionByName(state.d_rels), key, "left_anti")
        if gone:
            new["d_removals"] = reduce(DataFrame.unionByName, gone).distinct().join(state.d_removals, key, "left_anti")
        if cats:
            new["d_cats"] = reduce(DataFrame.unionByName, cats).distinct().join(state.d_cats, ["trace_id", "eid", "category"], "left_anti")
        changed = set()
        for layer, df in new.items():
            df = saved(df)
            if not df.isEmpty():
                changed |= {x for _, r in active for x in writes(r) if x[0] == _KIND[layer]}
                state = state.with_(**{layer: saved(getattr(state, layer).unionByName(df))})


# ---------------------------------------------------------------- effects


@dataclass(frozen=True)
class Emit:
    """Append an event caused by the focus event, with property changes (eid, slot, value)."""

    action: str
    roles: dict[str, Any] = field(default_factory=dict)
    changing: tuple = ()

    __hash__ = object.__hash__


@dataclass(frozen=True)
class Change:
    eid: Var
    slot: str
    value: Any


@dataclass(frozen=True)
class CreateEntity:
    """A new entity named after the bindings; an id that exists stays as it is."""

    concept: str
    etype: str
    id_parts: tuple

    __hash__ = object.__hash__


@dataclass(frozen=True)
class DestroyEntity:
    eid: Var


@dataclass(frozen=True)
class AddRelation:
    name: str
    a0: Any
    a1: Any


@dataclass(frozen=True)
class RemoveRelation:
    name: str
    a0: Any
    a1: Any


@dataclass(frozen=True)
class ConsumeOne:
    """Take ``amount`` from the count of a stack; an empty or uncountable stack is destroyed."""

    eid: Var
    amount: Any = 1


@dataclass(frozen=True)
class TransferN:
    """Move ``amount`` of a stack to a new holder: all of it, or a split-off new stack."""

    eid: Var
    to: Var
    amount: Any
    relation: str = "havi"


@dataclass(frozen=True)
class Rule:
    """When an event of ``on`` matches with ``when``, apply ``effects`` once per binding."""

    name: str
    on: Event
    when: Clause | None
    effects: tuple

    __hash__ = object.__hash__


def event_hash(action: Column, roles: Column, causes: Column, quantity: Column) -> Column:
    """Twelve hex digits over action, sorted ``role=value`` texts, sorted causes and a quantity other than 1."""
    text = F.concat_ws("|", action, F.array_join(F.array_sort(roles), ","), F.array_join(F.array_sort(causes), ","), F.when(quantity.isNotNull() & (quantity != 1), quantity.cast("string")))
    return F.left(F.sha1(text.cast("binary")), F.lit(12))


def _fire(state: TraceState, rule: Rule, fired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New bindings of a rule and their memo rows."""
    ev = Var("_event")
    m = Matcher(state)
    on = replace(rule.on, var=ev)
    b = m.body(on)
    if rule.when is not None:
        b = m.body(rule.when, b)
    b = b.distinct()
    names = sorted(c for c in b.columns if c != "trace_id")
    b = b.withColumn("_key", F.md5(F.concat_ws("|", F.lit(rule.name), *[F.coalesce(F.col(c), F.lit("")) for c in names]).cast("binary")))
    b = saved(b.join(fired, ["trace_id", "_key"], "left_anti"))
    return b, b.select("trace_id", "_key")


def _append_events(state: TraceState, b: DataFrame, e: Emit) -> TraceState:
    texts = F.array(*[F.concat(F.lit(f"{r}="), _col(v)) for r, v in e.roles.items()]) if e.roles else F.array().cast("array<string>")
    new = b.withColumn("event_id", event_hash(F.lit(e.action), texts, F.array("_event"), F.lit(None).cast("int")))
    new = saved(new.join(state.events.select("trace_id", "event_id").distinct(), ["trace_id", "event_id"], "left_anti").dropDuplicates(["trace_id", "event_id"]))
    top = state.events.groupBy("trace_id").agg(F.max("pos").alias("top"))
    order = F.row_number().over(_by_trace("event_id"))
    placed = saved(new.join(top, "trace_id", "left").withColumn("pos", (F.coalesce("top", F.lit(-1)) + order).cast("int")))
    events = placed.select("trace_id", "pos", "event_id", F.lit(e.action).alias("action"), F.lit(1).alias("quantity"))
    roles = state.roles
    for r, v in e.roles.items():
        roles = roles.unionByName(placed.select("trace_id", "event_id", F.lit(r).alias("role"), F.lit(0).alias("ord"), _col(v).alias("value")))
    causes = state.causes.unionByName(placed.select("trace_id", "event_id", F.col("_event").alias("cause")))
    changes = state.changes
    for c in e.changing:
        changes = changes.unionByName(placed.select("trace_id", "pos", _col(c.eid).alias("eid"), F.lit(c.slot).alias("slot"), _col(c.value).alias("value")))
    return state.with_(events=saved(state.events.unionByName(events)), roles=saved(roles), causes=saved(causes), changes=saved(changes))


def _by_trace(order: str):
    from pyspark.sql import Window as W

    return W.partitionBy("trace_id").orderBy(order)


def _synthetic(state: TraceState, rows: DataFrame) -> TraceState:
    """Property changes (trace_id, eid, slot, value) as one event per row."""
    top = state.events.groupBy("trace_id").agg(F.max("pos").alias("top"))
    rows = rows.withColumn("event_id", event_hash(F.lit("change"), F.array(F.concat_ws("=", "eid", "slot", "value")), F.array(F.col("_event")), F.lit(None).cast("int")))
    rows = rows.dropDuplicates(["trace_id", "event_id"]).join(top, "trace_id", "left")
    rows = saved(rows.withColumn("pos", (F.coalesce("top", F.lit(-1)) + F.row_number().over(_by_trace("event_id"))).cast("int")))
    events = state.events.unionByName(rows.select("trace_id", "pos", "event_id", F.lit("change").alias("action"), F.lit(1).alias("quantity")))
    causes = state.causes.unionByName(rows.select("trace_id", "event_id", F.col("_event").alias("cause")))
    changes = state.changes.unionByName(rows.select("trace_id", "pos", "eid", "slot", "value"))
    return state.with_(events=saved(events), causes=saved(causes), changes=saved(changes))


def _destroy(state: TraceState, rows: DataFrame) -> TraceState:
    last = state.events.groupBy("trace_id").agg((F.max("pos")).alias("_last"))
    dead = rows.select("trace_id", "eid").distinct().withColumn("_dead", F.lit(True))
    e = state.entities.join(dead, ["trace_id", "eid"], "left").join(last, "trace_id", "left")
    e = e.withColumn("destroyed_at", F.coalesce("destroyed_at", F.when(F.col("_dead"), F.coalesce("_last", F.lit(0))).cast("int")))
    return state.with_(entities=saved(e.select("trace_id", "eid", "concept", "etype", "created_at", "destroyed_at")))


def counted(state: TraceState, b: DataFrame, eid: Var, amount: Any) -> DataFrame:
    """Bindings with the stack's count (null: not countable) and the amount, as numbers."""
    count = state.current_props().where("slot = 'count'").select("trace_id", F.col("eid").alias(eid.name), F.expr("try_cast(value as int)").alias("_count"))
    return b.join(count, ["trace_id", eid.name], "left").withColumn("_n", _col(amount).try_cast("int"))


def apply(state: TraceState, b: DataFrame, effect: Any) -> TraceState:
    """State after one effect for all bindings at once."""
    key = ["trace_id", "relation", "a0", "a1"]
    tuples = lambda e: b.select("trace_id", F.lit(e.name).alias("relation"), _col(e.a0).alias("a0"), _col(e.a1).alias("a1")).distinct()
    match effect:
        case Emit():
            return _append_events(state, b, effect)
        case Change(eid, slot, value):
            return _synthetic(state, b.select("trace_id", "_event", _col(eid).alias("eid"), F.lit(slot).alias("slot"), _col(value).alias("value")))
        case CreateEntity(concept, etype, parts):
            at = state.events.groupBy("trace_id").agg(F.max("pos").alias("created_at"))
            new = b.select("trace_id", F.concat_ws("_", *[_col(p) for p in parts]).alias("eid"), F.lit(concept).alias("concept"), F.lit(etype).alias("etype")).dropDuplicates(["trace_id", "eid"])
            new = new.join(state.entities.select("trace_id", "eid"), ["trace_id", "eid"], "left_anti").join(at, "trace_id", "left")
            new = new.select("trace_id", "eid", "concept", "etype", "created_at", F.lit(None).cast("int").alias("destroyed_at"))
            return state.with_(entities=saved(state.entities.unionByName(new)))
        case DestroyEntity(eid):
            return _destroy(state, b.select("trace_id", _col(eid).alias("eid")))
        case AddRelation():
            return state.with_(relations=saved(state.relations.unionByName(tuples(effect).join(state.relations, key, "left_anti"))))
        case RemoveRelation():
            return state.with_(relations=saved(state.relations.join(tuples(effect), key, "left_anti")))
        case ConsumeOne(eid, amount):
            c = saved(counted(state, b, eid, amount))
            left = F.col("_count") - F.coalesce("_n", F.lit(1))
            gone = c.where(F.coalesce(left <= 0, F.lit(True))).select("trace_id", F.col(eid.name).alias("eid"))
            stay = c.where(left > 0).select("trace_id", "_event", F.col(eid.name).alias("eid"), F.lit("count").alias("slot"), left.cast("string").alias("value"))
            return _destroy(_synthetic(state, stay), gone)
        case TransferN(eid, to, amount, relation):
            c = saved(counted(state, b, eid, amount))
            split = F.coalesce(F.col("_n") < F.col("_count"), F.lit(False))
            whole, part = c.where(~split), c.where(split)
            # the whole stack changes hands
            old = whole.select("trace_id", F.lit(relation).alias("relation"), F.col(eid.name).alias("a1")).distinct()
            rel = state.relations.join(old, ["trace_id", "relation", "a1"], "left_anti").select(*key)
            rel = rel.unionByName(whole.select("trace_id", F.lit(relation).alias("relation"), _col(to).alias("a0"), F.col(eid.name).alias("a1")).distinct())
            # or a new stack is split off
            name = F.concat_ws("_", F.col(eid.name), _col(to), F.col("_event"))
            kind = state.entities.select("trace_id", F.col("eid").alias(eid.name), "concept", "etype")
            new = saved(part.withColumn("_new", name).join(kind, ["trace_id", eid.name]))
            rel = rel.unionByName(new.select("trace_id", F.lit(relation).alias("relation"), _col(to).alias("a0"), F.col("_new").alias("a1")))
            ents = state.entities.unionByName(new.select("trace_id", F.col("_new").alias("eid"), "concept", "etype", F.lit(0).alias("created_at"), F.lit(None).cast("int").alias("destroyed_at")))
            props = state.props.unionByName(new.select("trace_id", F.col("_new").alias("eid"), F.lit("count").alias("slot"), F.col("_n").cast("string").alias("value")))
            state = state.with_(relations=saved(rel), entities=saved(ents), props=saved(props))
            return _synthetic(state, new.select("trace_id", "_event", F.col(eid.name).alias("eid"), F.lit("count").alias("slot"), (F.col("_count") - F.col("_n")).cast("string").alias("value")))
    raise TypeError(type(effect).__name__)


def for_each(b: DataFrame, roles: DataFrame, role: str, var: Var) -> DataFrame:
    """One binding for each element of a list role of the focus event."""
    r = roles.where(F.col("role") == role).select("trace_id", F.col("event_id").alias("_event"), F.col("value").alias(var.name))
    return b.join(r, ["trace_id", "_event"])


def _touched(effect: Any) -> set | None:
    """Names an effect writes to; None where it may concern any rule (lives and stacks)."""
    match effect:
        case Emit(action=action, changing=changing):
            return {("action", action), ("action", "*")} | {("slot", c.slot) for c in changing}
        case Change(slot=slot):
            return {("slot", slot), ("action", "change"), ("action", "*")}
        case AddRelation(name=name) | RemoveRelation(name=name):
            return {("relation", name)}
    return None


def _reads_of(rule: Rule) -> set:
    from .introspect import reads

    return {("action", rule.on.action or "*")} | reads(rule.when)


def _with_derived(changed: set | None, derivations: list[Derivation]) -> set | None:
    """The changed names and all that derivations may make of them."""
    from .introspect import reads, writes

    while changed is not None:
        more = set().union(*[writes(d) for d in derivations if reads(d.when) & changed]) - changed
        if not more:
            break
        changed = changed | more
    return changed


def run(state: TraceState, rules: list[Rule], derivations: list[Derivation] = (), max_rounds: int | None = None) -> TraceState:
    """``run_again`` from an empty memo; the state alone."""
    return run_again(state, None, rules, derivations, max_rounds)[0]


def run_again(state: TraceState, fired: DataFrame | None, rules: list[Rule], derivations: list[Derivation] = (), max_rounds: int | None = None) -> tuple[TraceState, DataFrame]:
    """Derive, fire every rule on its new bindings, and repeat until nothing fires.

    ``max_rounds`` asks for so many rounds and no more; without it the rules must come to rest.
    A rule is matched again, and the derived layers rebuilt, only where something of a name
    they read was touched since; effects on lives and stacks may concern any rule.  ``fired``
    is the memo of an earlier run of the same scene: what fired then does not fire again.
    Gives the state and the memo.
    """
    from .introspect import reads

    if fired is None:
        fired = state.spark.createDataFrame([], T.StructType([T.StructField("trace_id", T.LongType()), T.StructField("_key", T.StringType())]))
    before: set | None = None  # names touched in the round before; None: any
    for done in count():
        if done == max_rounds:
            break
        if done > MAX_ROUNDS:
            raise NoFixpoint(f"rules still fire after {MAX_ROUNDS} rounds")
        if derivations and (before is None or any(reads(d.when) & before for d in derivations)):
            state = derive(state, list(derivations))
            before = _with_derived(before, list(derivations))
        quiet, here = True, set()
        for rule in rules:
            if before is not None and here is not None and not _reads_of(rule) & (before | here):
                continue
            b, memo = _fire(state, rule, fired)
            if b.isEmpty():
                continue
            quiet = False
            fired = saved(fired.unionByName(memo))
            for effect in rule.effects:
                state = apply(state, b, effect)
                names = _touched(effect)
                here = None if here is None or names is None else here | names
        if quiet:
            return state, fired
        before = here
    return (derive(state, list(derivations)) if derivations else state), fired


def ticks(state: TraceState, choose: Callable[[TraceState, int], DataFrame], rules: list[Rule], n: int, derivations: list[Derivation] = ()) -> TraceState:
    """``n`` ticks in which agents act and the rules answer.

    ``choose`` gives the acts of a tick as (trace_id, action, agent, theme), worked out on
    the state so far for all scenes at once; the memo of fired bindings lasts over the ticks."""
    fired = None
    for t in range(n):
        acts = choose(state, t).select("trace_id", "action", "agent", "theme").dropDuplicates()
        roles = F.array_compact(F.array(F.concat(F.lit("agent="), "agent"), F.concat(F.lit("theme="), "theme")))
        top = state.events.groupBy("trace_id").agg(F.max("pos").alias("top"))
        new = acts.withColumn("event_id", event_hash(F.col("action"), roles, F.array(F.lit(f"tick {t}")), F.lit(None).cast("int"))).join(top, "trace_id", "left")
        new = saved(new.withColumn("pos", (F.coalesce("top", F.lit(-1)) + F.row_number().over(_by_trace("event_id"))).cast("int")))
        events = state.events.unionByName(new.select("trace_id", "pos", "event_id", "action", F.lit(1).alias("quantity")))
        given = [new.where(F.col(r).isNotNull()).select("trace_id", "event_id", F.lit(r).alias("role"), F.lit(0).alias("ord"), F.col(r).alias("value")) for r in ("agent", "theme")]
        state = state.with_(events=saved(events), roles=saved(state.roles.unionByName(given[0]).unionByName(given[1])))
        state, fired = run_again(state, fired, rules, derivations)
    return state
