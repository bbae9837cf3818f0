"""Rule bodies as small expression trees, compiled to DataFrames of bindings.

A binding frame has ``trace_id`` and one column per variable.  Clauses are folded from
left to right; shared variables become join keys (by name, so Catalyst is free to pick
and reorder joins), comparisons become residual filters, and a negation is put off until
the variables it shares are bound and then becomes an anti join.  Variables that occur
only inside a negation are existential.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import closure
from .state import TraceState

ANY = ...  # slot set to anything


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class VarProp:
    """A slot of another bound entity, read as a number in comparisons."""

    var: Var
    slot: str


class Clause:
    def __and__(self, other: Clause) -> And:
        return And((self, other))

    def __or__(self, other: Clause) -> Or:
        return Or((self, other))

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class Entity(Clause):
    """Conjunctive predicate on one entity."""

    var: Var
    type: str | None = None
    concept: str | None = None
    category: str | None = None
    has_suffix: str | None = None
    slots: dict[str, Any] = field(default_factory=dict)  # slot -> value, (values), Var or ANY
    alive: bool = True

    __hash__ = object.__hash__


@dataclass(frozen=True)
class Rel(Clause):
    """A binary relation tuple; an argument is a Var, a literal or None (any)."""

    name: str
    a0: Any = None
    a1: Any = None


@dataclass(frozen=True)
class Event(Clause):
    """An event of an action; roles map to Vars or literals.  A role the event lacks never matches."""

    action: str | None
    roles: dict[str, Any] = field(default_factory=dict)
    var: Var | None = None
    pos: Var | None = None

    __hash__ = object.__hash__


@dataclass(frozen=True)
class CausedBy(Clause):
    """``event`` has ``cause`` among its direct causes (one step, not transitive)."""

    event: Var
    cause: Var


@dataclass(frozen=True)
class Closure(Clause):
    """Both ends are linked by a path over the named relations, direction ignored."""

    relations: tuple[str, ...]
    a0: Var
    a1: Var
    max_steps: int | None = None


@dataclass(frozen=True)
class Compare(Clause):
    """Strict comparison of numbers: missing or not numeric never matches."""

    left: Any
    op: str
    right: Any


@dataclass(frozen=True)
class Same(Clause):
    left: Var
    right: Var
    equal: bool = True


@dataclass(frozen=True)
class And(Clause):
    parts: tuple[Clause, ...]


@dataclass(frozen=True)
class Or(Clause):
    parts: tuple[Clause, ...]


@dataclass(frozen=True)
class Not(Clause):
    part: Clause


OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq}


def flat(c: Clause) -> list[Clause]:
    return [x for p in c.parts for x in flat(p)] if isinstance(c, And) else [c]


def variables(c: Clause) -> set[str]:
    """Names a clause binds when it is matched."""
    match c:
        case And(parts):
            return set().union(*(variables(p) for p in parts if not isinstance(p, Not)))
        case Or(parts):
            return set.intersection(*(variables(p) for p in parts))
        case Not():
            return set()
        case Entity(var=v, slots=s):
            return {v.name} | {x.name for x in s.values() if isinstance(x, Var)}
        case Rel(a0=a, a1=b):
            return {x.name for x in (a, b) if isinstance(x, Var)}
        case Event(roles=r, var=v, pos=p):
            return {x.name for x in (*r.values(), v, p) if isinstance(x, Var)}
        case CausedBy(event=e, cause=k):
            return {e.name, k.name}
        case Closure(a0=a, a1=b):
            return {a.name, b.name}
        case _:
            return set()


class Matcher:
    """Compiles clauses against one state; the views are built once."""

    def __init__(self, state: TraceState) -> None:
        self.state = state
        self.prop = state.eff_prop()
        self.rel = state.eff_rel()

    def entity(self, c: Entity) -> DataFrame:
        cat, v = self.state.catalog, c.var.name
        e = self.state.entities
        if c.alive:
            e = e.where("destroyed_at is null")
        if c.type is not None:
            e = e.where(F.col("etype").isin(*cat.subtypes(c.type)))
        if c.concept is not None:
            e = e.where(F.col("concept") == c.concept)
        if c.has_suffix is not None:
            e = e.where(F.col("concept").endswith(c.has_suffix))
        if c.category is not None:
            known = e.where(F.col("concept").isin(*cat.members(c.category))).select("trace_id", "eid")
            if self.state.d_cats is not None:
                known = known.unionByName(self.state.d_cats.where(F.col("category") == c.category).select("trace_id", "eid"))
            e = e.join(known.distinct(), ["trace_id", "eid"], "left_semi")
        out = e.select("trace_id", F.col("eid").alias(v))
        for slot, want in c.slots.items():
            p = self.prop.where(F.col("slot") == slot).select("trace_id", F.col("eid").alias(v), "value")
            if isinstance(want, Var):
                out = out.join(p.withColumnRenamed("value", want.name), ["trace_id", v])
                continue
            if want is not ANY:
                values = want if isinstance(want, (tuple, list, set, frozenset)) else (want,)
                p = p.where(F.col("value").isin(*values) if values else F.lit(False))
            out = out.join(p.select("trace_id", v), ["trace_id", v], "left_semi")
        return out

    def relation(self, c: Rel) -> DataFrame:
        r = self.rel.where(F.col("relation") == c.name)
        cols, keep = ["trace_id"], {}
        for col, arg in (("a0", c.a0), ("a1", c.a1)):
            if isinstance(arg, Var):
                if arg.name in keep:
                    r = r.where(F.col(keep[arg.name]) == F.col(col))
                else:
                    keep[arg.name] = col
            elif arg is not None:
                r = r.where(F.col(col) == arg)
        return r.select(*cols, *[F.col(col).alias(name) for name, col in keep.items()]).distinct()

    def event(self, c: Event) -> DataFrame:
        v = self.state.events
        if c.action is not None:
            v = v.where(F.col("action") == c.action)
        out = v.select("trace_id", F.col("event_id").alias("_e"), F.col("pos").alias("_p"))
        for role, want in c.roles.items():
            r = self.state.roles.where(F.col("role") == role).select("trace_id", F.col("event_id").alias("_e"), "value")
            if isinstance(want, Var):
                key = ["trace_id", "_e"] + ([want.name] if want.name in out.columns else [])
                out = out.join(r.withColumnRenamed("value", want.name), key)
            else:
                out = out.join(r.where(F.col("value") == want).select("trace_id", "_e"), ["trace_id", "_e"], "left_semi")
        extra = ([F.col("_e").alias(c.var.name)] if c.var else []) + ([F.col("_p").alias(c.pos.name)] if c.pos else [])
        names = [x.name for x in c.roles.values() if isinstance(x, Var)]
        out = out.select("trace_id", *dict.fromkeys(names), *extra)
        return out if c.var else out.distinct()

    def caused_by(self, c: CausedBy) -> DataFrame:
        return self.state.causes.select("trace_id", F.col("event_id").alias(c.event.name), F.col("cause").alias(c.cause.name)).distinct()

    def closed(self, c: Closure) -> DataFrame:
        edges = self.rel.where(F.col("relation").isin(*c.relations)).select("trace_id", F.col("a0").alias("src"), F.col("a1").alias("dst"))
        found = closure(edges, part="trace_id", directed=False, max_depth=c.max_steps)
        return found.select("trace_id", F.col("src").alias(c.a0.name), F.col("dst").alias(c.a1.name))

    def number(self, df: DataFrame, x: Any, name: str) -> DataFrame:
        if isinstance(x, VarProp):
            p = self.prop.where(F.col("slot") == x.slot).select("trace_id", F.col("eid").alias(x.var.name), F.expr("try_cast(value as double)").alias(name))
            return df.join(p, ["trace_id", x.var.name])
        if isinstance(x, Var):
            return df.withColumn(name, F.expr(f"try_cast(`{x.name}` as double)"))
        return df.withColumn(name, F.lit(x).try_cast("double"))

    def clause(self, c: Clause) -> DataFrame:
        match c:
            case Entity():
                return self.entity(c)
            case Rel():
                return self.relation(c)
            case Event():
                return self.event(c)
            case CausedBy():
                return self.caused_by(c)
            case Closure():
                return self.closed(c)
            case And():
                return self.body(c)
            case Or(parts):
                shared = sorted(variables(c))
                branches = [self.body(p).select("trace_id", *shared) for p in parts]
                return reduce(DataFrame.unionByName, branches).distinct()
        raise TypeError(f"cannot start a match from {type(c).__name__}")

    def _filter(self, df: DataFrame, c: Clause) -> DataFrame:
        match c:
            case Compare(left, op, right):
                cols = df.columns
                out = self.number(self.number(df, left, "_l"), right, "_r")
                return out.where(OPS[op](F.col("_l"), F.col("_r"))).select(*cols).distinct()
            case Same(left, right, equal):
                same = F.col(left.name) == F.col(right.name)
                return df.where(same if equal else ~same)
        raise TypeError(type(c).__name__)

    def body(self, c: Clause, given: DataFrame | None = None) -> DataFrame:
        """Bindings of a conjunction, starting from ``given`` bindings where there are any."""
        df, later = given, []
        for p in flat(c):
            if isinstance(p, (Not, Compare, Same)):
                later.append(p)
                continue
            m = self.clause(p)
            df = m if df is None else df.join(m, [x for x in m.columns if x in df.columns])
        if df is None:
            raise ValueError("a rule body needs one positive clause")
        for p in later:
            if isinstance(p, Not):
                inner = self.body(p.part, df.distinct() if _open(p.part) else None)
                keys = [x for x in inner.columns if x in df.columns]
                df = df.join(inner.select(*keys).distinct(), keys, "left_anti")
            else:
                df = self._filter(df, p)
        return df


def _open(c: Clause) -> bool:
    """Does a negated body compare variables that only the outer body binds?"""
    return any(isinstance(p, (Compare, Same)) for p in flat(c))


def check_safety(body: Clause, used: set[str]) -> None:
    """Every variable a head uses must be bound by a positive clause of the body."""
    loose = used - variables(And(tuple(flat(body))))
    if loose:
        raise ValueError(f"unbound in the body: {sorted(loose)}")


def match(state: TraceState, body: Clause) -> DataFrame:
    return Matcher(state).body(body)
