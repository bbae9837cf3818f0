from velkora.operators import introspect as I
from velkora.operators.fixpoint import Change, ConsumeOne, Derivation, Emit, Property, Relation, Rule
from velkora.operators.rules import Entity, Event, Rel, Var

A, B, C = Var("a"), Var("b"), Var("c")


def test_derivations():
    rules = [
        Derivation("wet", Rel("in", A, B) & ~Entity(B, slots={"dry": "yes"}), (Property(A, "wet", "yes"),)),
        Derivation("cold", Entity(A, slots={"wet": "yes"}), (Property(A, "cold", "yes"),)),
        Derivation("base", Rel("in", A, B), (Relation("within", A, B),)),
        Derivation("step", Rel("within", A, B) & Rel("in", B, C), (Relation("within", A, C),)),
    ]
    assert I.derivable_slots(rules) == {"wet", "cold"}
    assert I.reads(rules[0].when) == {("relation", "in"), ("slot", "dry")}
    assert I.dependents(rules)["wet"] == {"cold"} and "step" in I.dependents(rules)["base"]
    assert I.layers(rules)[0] == ["wet", "base"] and "cold" in I.layers(rules)[1]


def test_rules():
    rules = [
        Rule("r1", Event("fall", {"theme": A}), None, (Emit("break", {"theme": A}),)),
        Rule("r2", Event("break", {"theme": A}), None, (Emit("spill", {"theme": A}, (Change(A, "state", "broken"),)),)),
        Rule("r3", Event("eat", {"theme": A}), None, (ConsumeOne(A),)),
    ]
    assert I.cascades(rules)["fall"] == {"break", "spill"}
    assert I.actions_that(rules, "consume") == {"eat"}
    assert I.satisfiers(rules, "state", "broken") == {"break", "fall"}
    assert I.satisfiers(rules, "state", "whole") == set()
