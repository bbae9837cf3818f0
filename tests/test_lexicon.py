"""Lexicon folders: loading, inheritance, composition and loud problems."""

import json

import pytest
from pyspark.sql import functions as F

from velkora.operators import predicates as P
from velkora.operators.rules import Entity, Var, match
from velkora.operators.state import Catalog, empty_state
from velkora.sources import lexicon

X = Var("x")


def write(folder, **files):
    for name, rows in files.items():
        if name == "types":
            (folder / "types.json").write_text(json.dumps(rows))
        else:
            (folder / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n", encoding="utf-8")
    return str(folder)


GOOD = {
    "types": {"thing": None, "animal": "thing"},
    "slots": [{"name": "material", "vocabulary": ["wood", "stone"], "scalar": True}, {"name": "smell", "scalar": False}],
    "concepts": [
        {"lemma": "meblo", "entity_type": "thing", "properties": {"material": ["wood"]}},
        {"lemma": "tablo", "entity_type": "thing", "category": ["meblo"], "properties": {"smell": ["pine", "oil"]}},
        {"lemma": "altaro", "entity_type": "thing", "category": ["tablo"], "properties": {"material": ["stone"]}},
    ],
    "relations": [{"name": "near", "arity": 2, "arg_types": ["thing", "thing"], "symmetric": True}],
    "actions": [{"lemma": "rompi", "roles": [{"name": "theme", "type": "thing"}], "effects": [{"target_role": "theme", "property": "material", "value": "wood"}]}],
    "affixes": [{"form": "ej", "kind": "suffix", "attaches_to": "thing", "output_type": "thing"}],
}


def test_load(spark, tmp_path):
    lx = lexicon.load(spark, write(tmp_path, **GOOD), strict=True)
    got = {(r.owner, r.slot, r.value) for r in lx.props.collect()}
    assert ("tablo", "material", "wood") in got and ("altaro", "material", "stone") in got and ("altaro", "material", "wood") not in got
    assert lx.catalog.subtypes("thing") == ["animal", "thing"]
    assert lx.catalog.members("meblo") == ["altaro", "meblo", "tablo"]
    assert lx.catalog.symmetric == {"near"} and lx.catalog.multi_valued == {"smell"}
    assert {r.lemma for r in lexicon.composed(lx.concepts, lx.affixes).collect()} == {"meblejo", "tablejo", "altarejo"}
    assert lx.containment.count() == 0


def test_problems_are_reported(spark, tmp_path):
    bad = GOOD | {
        "types": {"thing": "nowhere"},
        "concepts": [{"lemma": "a", "entity_type": "ghost", "properties": {"material": ["iron"], "color": ["red"]}}],
        "relations": [{"name": "r", "arity": 3, "arg_types": ["thing"], "symmetric": False}],
        "actions": [{"lemma": "v", "roles": [{"name": "agent", "type": "thing"}], "effects": [{"target_role": "theme", "property": "p", "value": "x"}]}],
    }
    folder = write(tmp_path, **bad)
    reasons = {r.reason for r in lexicon.load(spark, folder).violations.collect()}
    assert reasons == {"unknown type", "not in vocabulary", "unknown slot", "arity", "effect on unknown role", "unknown parent"}
    with pytest.raises(ValueError):
        lexicon.load(spark, folder, strict=True)


def test_predicates(spark):
    cat = Catalog(types={"thing": None, "animal": "thing"})
    df = spark.createDataFrame([(1, "kato", "animal", {"size": ["big"]}), (2, "domo", "thing", {}), (3, "x", None, None)], "id long, concept string, etype string, props map<string, array<string>>")
    ids = lambda p: sorted(r.id for r in df.where(P.json_predicate(p, cat)).collect())
    assert ids({"entity": {"type": "thing"}}) == [1, 2]
    assert ids({"not": {"entity": {"size": "big"}}}) == [2, 3]
    assert ids({"or": []}) == [] and ids({"and": []}) == [1, 2, 3]
    with pytest.raises(ValueError):
        P.json_predicate({"xor": []}, cat)
    v = spark.createDataFrame([("1", "2"), ("a", "2"), (None, "2")], "a string, b string")
    assert v.where(P.compare_values(F.col("a"), "<", F.col("b"))).count() == 1
    assert v.where(P.compare_values(F.col("a"), "<", F.col("b"), strict=False)).count() == 3


def test_preconditions_hold_vacuously(spark):
    b = spark.createDataFrame([(1, "b1", "a", "c"), (1, "b2", "d", "c")], "trace_id long, bid string, x string, y string")
    props = spark.createDataFrame([(1, "a", "s", "v")], "trace_id long, eid string, slot string, value string")
    rel = spark.createDataFrame([(1, "r", "a", "c")], "trace_id long, relation string, a0 string, a1 string")
    ok = lambda k, s: sorted(r.bid for r in P.permitted(b, [(k, s)], props, rel).collect())
    assert ok("relation", {"name": "r", "a0": "x", "a1": "y"}) == ["b1"]
    assert ok("not_relation", {"name": "r", "a0": "x", "a1": "y"}) == ["b2"]
    assert ok("has_property", {"role": "x", "slot": "s", "value": "v"}) == ["b1"]
    assert ok("not_property", {"role": "x", "slot": "s", "value": "v"}) == ["b2"]
    assert ok("if_property", {"role": "x", "slot": "s", "value": "v", "then": {"role": "y", "slot": "s", "value": "v"}}) == ["b2"]
    assert ok("match", {"a": "x", "b": "y", "slot": "s"}) == []  # a side without a value never matches
    assert ok("or", {"any": [("relation", {"name": "r", "a0": "x", "a1": "y"}), ("not_property", {"role": "x", "slot": "s", "value": "v"})]}) == ["b1", "b2"]


def test_loaded_catalog_drives_matching(spark, tmp_path):
    lx = lexicon.load(spark, write(tmp_path, **GOOD))
    s = empty_state(spark, lx.catalog, entities=[(1, "t1", "altaro", "thing", None, None), (1, "k1", "kato", "animal", None, None)])
    assert [r.x for r in match(s, Entity(X, category="meblo")).collect()] == ["t1"]
