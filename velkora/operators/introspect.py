"""What a set of rules can do, read off their trees on the driver (no data is touched)."""

from __future__ import annotations

from collections import defaultdict

from .fixpoint import AddRelation, Category, Change, ConsumeOne, CreateEntity, Derivation, DestroyEntity, Emit, NotRelation, Property, Relation, RemoveRelation, Rule, TransferN
from .rules import And, CausedBy, Clause, Closure, Compare, Entity, Event, Not, Or, Rel, VarProp

Fact = tuple[str, str]


def reads(c: Clause | None) -> set[Fact]:
    """Slots, relations, categories and actions a body looks at, negated ones too."""
    match c:
        case None:
            return set()
        case And(parts) | Or(parts):
            return set().union(*(reads(p) for p in parts))
        case Not(part):
            return reads(part)
        case Entity(slots=slots, category=category):
            return {("slot", s) for s in slots} | ({("category", category)} if category else set())
        case Rel(name=name):
            return {("relation", name)}
        case Closure(relations=names):
            return {("relation", n) for n in names}
        case Event(action=action):
            return {("action", action or "*")}
        case CausedBy():
            return {("action", "*")}
        case Compare(left=a, right=b):
            return {("slot", x.slot) for x in (a, b) if isinstance(x, VarProp)}
        case _:
            return set()


def writes(d: Derivation) -> set[Fact]:
    out = set()
    for h in d.then:
        match h:
            case Property(slot=s):
                out.add(("slot", s))
            case Relation(name=n) | NotRelation(name=n):
                out.add(("relation", n))
            case Category(category=c):
                out.add(("category", c))
    return out


def derivable_slots(rules: list[Derivation]) -> set[str]:
    return {n for d in rules for k, n in writes(d) if k == "slot"}


def dependents(rules: list[Derivation]) -> dict[str, set[str]]:
    """name -> derivations that read what it writes."""
    return {a.name: {b.name for b in rules if writes(a) & reads(b.when)} for a in rules}


def layers(rules: list[Derivation]) -> list[list[str]]:
    """Derivations in layers: each reads only what asserted state and earlier layers give;
    those that depend on each other share the last layer."""
    after = dependents(rules)
    need = {b.name: {a for a in after if b.name in after[a]} for b in rules}
    out: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(rules):
        ready = [r.name for r in rules if r.name not in done and need[r.name] <= done]
        if not ready:
            ready = [r.name for r in rules if r.name not in done]
        out.append(ready)
        done |= set(ready)
    return out


def outcomes(rules: list[Rule]) -> dict[str, set[tuple]]:
    """action -> what its rules bring about: emits, changes, relations, lives and stacks."""
    out: dict[str, set[tuple]] = defaultdict(set)
    for r in rules:
        for e in r.effects:
            match e:
                case Emit(action=a, changing=cs):
                    out[r.on.action].add(("emit", a))
                    out[r.on.action] |= {("change", c.slot, str(c.value)) for c in cs}
                case Change(slot=s, value=v):
                    out[r.on.action].add(("change", s, str(v)))
                case AddRelation(name=n):
                    out[r.on.action].add(("add", n))
                case RemoveRelation(name=n):
                    out[r.on.action].add(("remove", n))
                case CreateEntity(concept=c):
                    out[r.on.action].add(("create", c))
                case DestroyEntity():
                    out[r.on.action].add(("destroy",))
                case ConsumeOne():
                    out[r.on.action].add(("consume",))
                case TransferN(relation=n):
                    out[r.on.action].add(("transfer", n))
    return dict(out)


def cascades(rules: list[Rule]) -> dict[str, set[str]]:
    """action -> actions it can set off, over any number of steps."""
    step = {a: {x[1] for x in o if x[0] == "emit"} for a, o in outcomes(rules).items()}
    out = {}
    for a in step:
        seen, todo = set(), list(step[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += step.get(b, ())
        out[a] = seen
    return out


def actions_that(rules: list[Rule], kind: str) -> set[str]:
    """Actions with an outcome of a kind (consume, transfer, destroy, …), cascades included."""
    direct = {a for a, o in outcomes(rules).items() if any(x[0] == kind for x in o)}
    return direct | {a for a, later in cascades(rules).items() if later & direct}


def satisfiers(rules: list[Rule], slot: str, value: str) -> set[str]:
    """Actions that can give a slot a value, directly or through what they set off."""
    direct = {a for a, o in outcomes(rules).items() if ("change", slot, value) in o}
    return direct | {a for a, later in cascades(rules).items() if later & direct}
