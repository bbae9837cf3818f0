"""Behaviours of the rule engine on a small world."""

import pytest

from velkora.operators.fixpoint import AddRelation, Category, Change, ConsumeOne, CreateEntity, Derivation, DestroyEntity, Emit, NotRelation, Property, Relation, RemoveRelation, Rule, TransferN, derive, run
from velkora.operators.rules import ANY, CausedBy, Closure, Compare, Entity, Event, Rel, Same, Var, VarProp, match
from velkora.operators.state import Catalog, empty_state

A, B, C, X, Y = (Var(n) for n in "abcxy")
CAT = Catalog(types={"thing": None, "animal": "thing", "lamp": "thing"}, categories={"cat": ("pet",), "pet": ("being",), "being": ("pet",)}, symmetric=frozenset({"near"}), multi_valued=frozenset({"smell"}))


@pytest.fixture(scope="module")
def world(spark):
    ent = [(1, "cat1", "cat", "animal", None, None), (1, "box1", "box", "thing", None, None), (1, "room1", "room", "thing", None, None), (1, "lamp1", "lamp", "lamp", None, None), (1, "ghost", "cat", "animal", None, 2), (2, "cat1", "cat", "animal", None, None)]
    props = [(1, "cat1", "weight", "4.5"), (1, "box1", "weight", "2"), (1, "room1", "weight", "heavy"), (1, "lamp1", "on", "yes"), (1, "cat1", "smell", "fish"), (1, "box1", "count", "3")]
    rel = [(1, "in", "cat1", "box1"), (1, "in", "box1", "room1"), (1, "in", "lamp1", "room1"), (1, "near", "cat1", "lamp1"), (1, "near", "box1", "box1"), (1, "has", "cat1", "box1")]
    ev = [(1, 0, "e0", "fall", 1), (1, 1, "e1", "cry", 1), (2, 0, "e0", "fall", 1)]
    roles = [(1, "e0", "theme", 0, "box1"), (1, "e1", "agent", 0, "cat1"), (2, "e0", "theme", 0, "cat1"), (1, "e0", "to", 0, "lamp1")]
    causes = [(1, "e1", "e0")]
    return empty_state(spark, CAT, entities=ent, props=props, relations=rel, events=ev, roles=roles, causes=causes)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_entity_constraints(world):
    assert rows(match(world, Entity(X, type="animal")), "trace_id", "x") == [(1, "cat1"), (2, "cat1")]
    assert rows(match(world, Entity(X, type="thing")), "x")[:2] == [("box1",), ("cat1",)]
    assert rows(match(world, Entity(X, type="unknown")), "x") == []
    assert rows(match(world, Entity(X, category="being")), "trace_id", "x") == [(1, "cat1"), (2, "cat1")]
    assert rows(match(world, Entity(X, slots={"weight": ANY})), "x") == [("box1",), ("cat1",), ("room1",)]
    assert rows(match(world, Entity(X, slots={"weight": ()})), "x") == []


def test_symmetric_relation_once_for_self_pairs(world):
    assert rows(match(world, Rel("near", A, B)), "a", "b") == [("box1", "box1"), ("cat1", "lamp1"), ("lamp1", "cat1")]
    assert rows(match(world, Rel("near", A, A)), "a") == [("box1",)]


def test_negation_or_and_compare(world):
    assert rows(match(world, Entity(X, type="thing") & ~Rel("in", X, Y)), "trace_id", "x") == [(1, "room1"), (2, "cat1")]
    assert rows(match(world, Rel("in", A, B) | Rel("has", A, B)), "a", "b") == [("box1", "room1"), ("cat1", "box1"), ("lamp1", "room1")]
    # missing and non-numeric sides never match
    assert rows(match(world, Rel("in", A, B) & Compare(VarProp(A, "weight"), ">", VarProp(B, "weight"))), "a", "b") == [("cat1", "box1")]
    assert rows(match(world, Rel("in", A, C) & Rel("in", B, C) & Same(A, B, equal=False)), "a", "b") == [("box1", "lamp1"), ("lamp1", "box1")]


def test_closure_and_causes(world):
    assert ("cat1", "room1") in rows(match(world, Closure(("in",), A, B)), "a", "b")
    assert ("cat1", "room1") not in rows(match(world, Closure(("in",), A, B, max_steps=1)), "a", "b")
    assert rows(match(world, Event("fall", var=Y) & CausedBy(X, Y)), "x", "y") == [("e1", "e0")]
    assert rows(match(world, Event("fall", {"agent": A})), "a") == []  # a role the event lacks


def test_unbound_head_is_refused():
    with pytest.raises(ValueError):
        Derivation("bad", Rel("in", A, B), (Property(C, "s", "v"),))


def test_derivations(world):
    rules = [
        Derivation("hot", Entity(X, slots={"on": "yes"}), (Property(X, "lit", "yes"), Property(X, "weight", "1"))),
        Derivation("dark", Entity(X, type="thing"), (Property(X, "lit", "no"),)),
        Derivation("inside", Rel("in", A, B), (Relation("within", A, B),)),
        Derivation("chain", Rel("within", A, B) & Rel("in", B, C), (Relation("within", A, C),)),
        Derivation("hide", Rel("near", A, B) & Entity(A, concept="cat"), (NotRelation("near", A, B),)),
        Derivation("pet", Entity(X, concept="cat"), (Category(X, "friend"),)),
        Derivation("smell", Rel("in", A, B) & Entity(A, slots={"smell": Y}), (Property(B, "smell", Y),)),
    ]
    s = derive(world, rules)
    props = rows(s.d_props, "trace_id", "eid", "slot", "value")
    assert (1, "lamp1", "lit", "yes") in props and (1, "lamp1", "lit", "no") not in props  # first rule wins
    assert (1, "cat1", "lit", "no") in props
    assert not [p for p in props if p[:3] == (1, "cat1", "weight")]
    assert (1, "lamp1", "weight", "1") in props
    assert (1, "box1", "smell", "fish") in props and (1, "room1", "smell", "fish") in props  # multi-valued chains
    assert (1, "within", "cat1", "room1") in rows(s.d_rels, "trace_id", "relation", "a0", "a1")
    # a mask is tested on the stored order, so both orders disappear
    assert rows(s.eff_rel().where("relation = 'near'"), "a0", "a1") == [("box1", "box1")]
    assert rows(match(s, Entity(X, category="friend")), "trace_id", "x") == [(1, "cat1"), (2, "cat1")]
    # asserted wins over derived
    assert rows(s.eff_prop().where("slot = 'weight' and eid = 'box1'"), "value") == [("2",)]


def test_cascade_and_memo(world):
    fall = Rule("spill", Event("fall", {"theme": X}), Rel("in", Y, X), (Emit("spill", {"theme": Y}, (Change(Y, "wet", "yes"),)),))
    loud = Rule("loud", Event("spill", {"theme": X}), None, (Emit("noise", {"source": X}),))
    s = run(world, [fall, loud])
    assert rows(s.events.where("action in ('spill', 'noise')"), "trace_id", "pos", "action") == [(1, 2, "spill"), (1, 3, "noise")]
    assert rows(s.current_props().where("slot = 'wet'"), "eid", "value") == [("cat1", "yes")]


def test_other_effects(world):
    rule = Rule("r", Event("fall", {"theme": X, "to": Y}), None, (CreateEntity("shard", "thing", ("shard", X)), AddRelation("in", Y, X), RemoveRelation("in", Y, "room1"), DestroyEntity(Y)))
    s = run(world, [rule], max_rounds=1)
    assert ("shard_box1", "shard") in rows(s.entities, "eid", "concept")
    assert rows(s.relations.where("a0 = 'lamp1'"), "relation", "a1") == [("in", "box1")]
    assert rows(s.entities.where("eid = 'lamp1'"), "destroyed_at") == [(1,)]


def test_stacks(world):
    s = run(world, [Rule("eat", Event("fall", {"theme": X}), None, (ConsumeOne(X),))], max_rounds=1)
    assert rows(s.current_props().where("slot = 'count'"), "trace_id", "value") == [(1, "2")]
    assert rows(s.entities.where("destroyed_at is not null"), "trace_id", "eid") == [(1, "ghost"), (2, "cat1")]  # no count: destroyed
    t = run(world, [Rule("give", Event("fall", {"theme": X, "to": Y}), None, (TransferN(X, Y, 2, "has"),))], max_rounds=1)
    assert rows(t.relations.where("relation = 'has'"), "a0", "a1") == [("cat1", "box1"), ("lamp1", "box1_lamp1_e0")]
    assert rows(t.current_props().where("slot = 'count'"), "eid", "value") == [("box1", "1"), ("box1_lamp1_e0", "2")]
    w = run(world, [Rule("give", Event("fall", {"theme": X, "to": Y}), None, (TransferN(X, Y, 3, "has"),))], max_rounds=1)
    assert rows(w.relations.where("relation = 'has'"), "a0", "a1") == [("lamp1", "box1")]


def test_matcher_agrees_with_naive_evaluator(spark):
    """Random traces: two-hop join with negation against plain Python."""
    import random

    rng = random.Random(5)
    ents, rels = [], []
    for t in range(30):
        n = rng.randint(2, 6)
        ents += [(t, f"e{i}", rng.choice(["cat", "box"]), rng.choice(["animal", "thing", None]), None, None) for i in range(n)]
        rels += list({(t, rng.choice(["in", "on"]), f"e{rng.randrange(n)}", f"e{rng.randrange(n)}") for _ in range(8)})
    s = empty_state(spark, CAT, entities=ents, relations=rels)
    got = rows(match(s, Rel("in", A, B) & Rel("on", B, C) & ~Rel("in", C, A)), "trace_id", "a", "b", "c")
    have = set(rels)
    want = sorted({(t, a, b, c) for (t, r, a, b) in have if r == "in" for (u, q, b2, c) in have if u == t and q == "on" and b2 == b and (t, "in", c, a) not in have})
    assert got == want
