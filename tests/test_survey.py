"""Cases of the reference's behaviour that the tables do not hold: loops, schemas, containment, parses, writes."""

import pytest
from pyspark.sql import functions as F

from velkora.functions import morphology
from velkora.operators import closure, events, predicates, registry, sequences, validate
from velkora.operators.fixpoint import Derivation, Emit, NoFixpoint, Relation, Rule, derive, run
from velkora.operators.rules import Event, Rel, Var
from velkora.operators.state import Catalog, empty_state
from velkora.plans import planner
from velkora.sources import sinks

X, Y, Z = Var("x"), Var("y"), Var("z")
CATALOG = Catalog(types={"thing": None, "box": "thing", "person": "thing", "place": None})


def chain(spark, n=60):
    return spark.createDataFrame([(1, f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)], "trace_id long, src string, dst string")


def test_long_chains_are_followed_to_their_end(spark):
    c = closure.closure(chain(spark), part="trace_id", seeds=spark.createDataFrame([(1, "n000")], "trace_id long, src string"))
    assert c.count() == 60 and c.agg(F.max("depth")).first()[0] == 60
    e = chain(spark)
    causes = e.select("trace_id", F.col("dst").alias("event_id"), F.col("src").alias("cause"))
    evs = e.select("trace_id", F.col("src").alias("event_id")).unionByName(e.select("trace_id", F.col("dst").alias("event_id"))).distinct()
    assert events.causal_depth(evs, causes).agg(F.max("depth")).first()[0] == 60
    assert {(r.depth, r.n_paths) for r in events.chain_paths(evs, causes).collect()} == {(d, 61 - d) for d in range(1, 61)}
    up = validate.container_chain(e.select("trace_id", F.lit("in").alias("relation"), F.col("src").alias("a0"), F.col("dst").alias("a1")))
    assert up.where("eid = 'n000'").count() == 60


def test_cycles_of_causes_raise(spark):
    causes = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "trace_id long, event_id string, cause string")
    evs = spark.createDataFrame([(1, "a"), (1, "b")], "trace_id long, event_id string")
    for f in (events.causal_depth, events.chain_paths):
        with pytest.raises(ValueError, match="cycle"):
            f(evs, causes).count()


def test_rules_that_never_rest_raise(spark, monkeypatch):
    from velkora.operators import fixpoint

    monkeypatch.setattr(fixpoint, "MAX_ROUNDS", 3)
    s = empty_state(spark, CATALOG, entities=[(1, "a", "cup", "box", None, None)], events=[(1, 0, "e0", "ring", 1)], roles=[(1, "e0", "theme", 0, "a")])
    rule = Rule("echo", Event("ring", {"theme": X}), None, (Emit("ring", {"theme": X}),))
    assert run(s, [rule], max_rounds=2).events.count() == 3
    with pytest.raises(NoFixpoint):
        run(s, [rule])
    rels = [(1, "in", f"n{i}", f"n{i + 1}") for i in range(6)]
    far = [Derivation("far", Rel("in", X, Y) & Rel("in", Y, Z), (Relation("in", X, Z),))]
    state = empty_state(spark, CATALOG, relations=rels)
    assert derive(state, far).d_rels.count() == 15
    with pytest.raises(NoFixpoint):
        derive(state, far, max_rounds=1)


def test_relaxed_costs_and_plans_over_long_ways(spark):
    steps = [(1, "go", f"{i}", [f"at|{i}"], [f"at|{i + 1}"], [f"at|{i}"], 1) for i in range(60)]
    acts = spark.createDataFrame(steps, "trace_id long, action string, binding string, pre array<string>, add array<string>, del array<string>, cost int")
    start = spark.createDataFrame([(1, "at|0")], "trace_id long, fact string")
    assert planner.relaxed_costs(start, acts).where("fact = 'at|60'").first().cost == 60
    goals = spark.createDataFrame([(1, "at|60"), (1, "at|99")], "trace_id long, goal string")
    got = {r.goal: (r.found, r.n_steps) for r in planner.search(start, acts, goals).collect()}
    assert got == {"at|60": (True, 60), "at|99": (False, 0)}
    assert {r.goal: r.found for r in planner.search(start, acts, goals, max_states=5).collect()} == {"at|60": None, "at|99": False}


def test_preconditions_with_unbound_roles_and_two_slots(spark):
    b = spark.createDataFrame([(1, "1", "a", "b"), (1, "2", "a", None), (1, "3", "a", "c")], "trace_id long, bid string, x string, y string")
    props = spark.createDataFrame([(1, "a", "colour", "red"), (1, "b", "wants", "red"), (1, "b", "colour", "blue")], "trace_id long, eid string, slot string, value string")
    rel = spark.createDataFrame([(1, "in", "a", "b")], "trace_id long, relation string, a0 string, a1 string")
    ok = lambda kind, spec: sorted(r.bid for r in predicates.precondition(b, kind, spec, props, rel).where("ok").collect())
    assert ok("relation", {"name": "in", "a0": "x", "a1": "y"}) == ["1", "2"]
    assert ok("not_relation", {"name": "in", "a0": "x", "a1": "y"}) == ["2", "3"]
    assert ok("match", {"a": "x", "b": "y", "slot_a": "colour", "slot_b": "wants"}) == ["1"]
    assert ok("match", {"a": "x", "b": "y", "slot": "colour"}) == []
    assert ok("has_property", {"role": "y", "slot": "wants", "value": "red"}) == ["1"]
    assert ok("not_property", {"role": "y", "slot": "wants", "value": "red"}) == ["2", "3"]


CONCEPTS = [("kitchen", "place", {}), ("cup", "box", {"hot": ["yes"]}), ("cupboard", "box", {}), ("spoon", "thing", {"hot": ["yes"], "metal": ["yes"]}), ("ghost", "person", {})]


def facts_of(spark, facts):
    c = spark.createDataFrame(CONCEPTS, "concept string, etype string, props map<string,array<string>>")
    return validate.containment_facts(c, facts, CATALOG)


def test_containment_patterns(spark):
    ent = lambda **k: {"entity": k}
    f = facts_of(spark, [
        {"relation": "in", "container": ent(type="place"), "contained": ent(concept="cupboard")},
        {"relation": "in", "container": ent(type="box", has_suffix="board"), "contained": ent(hot="yes", metal="yes")},
        {"relation": "near", "container": ent(type="place"), "contained": ent(type="person"), "contains": "spoon"},
        {"relation": "near", "container": ent(type="box"), "contained": ent(type="person"), "contains": "cup"},
    ])
    got = {(r.container, r.contained, r.relation) for r in f.collect()}
    # all fields of a pattern must match; what is reached by first facts alone counts for ``contains``
    assert got == {("kitchen", "cupboard", "in"), ("cupboard", "spoon", "in"), ("kitchen", "ghost", "near")}
    assert {r.concept for r in validate.reachable_concepts(f, "kitchen").collect()} == {"kitchen", "cupboard", "spoon", "ghost"}
    for bad in ({"relation": "in", "container": ent(type="box")}, {"relation": "in", "container": {}, "contained": ent(type="box")}, {"relation": "in", "container": ent(), "contained": ent(), "colour": 1}):
        with pytest.raises(ValueError):
            facts_of(spark, [bad])


def test_relation_checks_in_order(spark):
    e = spark.createDataFrame([(1, "k", "kitchen", "place", {}), (1, "c", "cup", "box", {"weight": ["9"]}), (1, "g", "ghost", "person", {"strength": ["5"]}), (1, "h", "ghost", "person", {}), (1, "s", "spoon", "thing", {"hot": ["yes"]})], "trace_id long, eid string, concept string, etype string, props map<string,array<string>>")
    schemas = {
        "in": validate.RelationSchema(("thing", "place"), excludes={0: ("person",)}, not_part=(0,)),
        "has": validate.RelationSchema(("thing", "person"), patterns={0: {"not": {"entity": {"hot": "yes"}}}}, compare=((0, "weight", "<=", 1, "strength"),)),
        "likes": validate.RelationSchema(("person", None), kinds=("entity", "slot")),
        "says": validate.RelationSchema(("person", None), kinds=("entity", "literal")),
    }
    want = {
        ("near", "c k"): "unknown relation", ("in", "c"): "arity", ("in", "c x"): "kind", ("in", "c g"): "type", ("in", "g k"): "excluded", ("in", "s k"): "part", ("in", "c k"): "containment",
        ("has", "s g"): "pattern", ("has", "c g"): "compare", ("has", "c h"): None, ("likes", "g hot"): None, ("likes", "g tall"): "kind", ("says", "g anything"): None,
    }
    r = spark.createDataFrame([(1, k, a.split()) for k, a in want], "trace_id long, relation string, args array<string>")
    parts = spark.createDataFrame([(1, "s")], "trace_id long, eid string")
    allowed = facts_of(spark, [{"relation": "in", "container": {"entity": {"type": "place"}}, "contained": {"entity": {"concept": "cupboard"}}}])
    got = validate.checked_relations(r, e, schemas, CATALOG, slots=("hot",), parts=parts, allowed=allowed, contained=("in",))
    assert {(x.relation, " ".join(x.args)): x.reason for x in got.collect()} == want


def test_rules_by_module():
    reg = registry.Registry()

    @reg
    def spoken():
        return registry.announcement("arrive", "greet")

    @reg
    def places():
        return registry.per_locative(("on", "under"), "in")

    assert [r.name for r in reg.rules] == ["greet after arrive"] and len(reg.derivations) == 2
    with pytest.raises(ValueError):
        reg(spoken)


def test_word_splits_follow_one_order():
    d = morphology.Dictionary(roots=frozenset({"bel", "lern", "patr", "ŝip", "kapitan", "malbel"}))
    cut = lambda w: morphology.decompose(w, d)
    assert cut("malbelajn") == ["malbel", "a", "j", "n"]  # a whole root goes first
    assert cut("gepatroj") == ["ge", "patr", "o", "j"]
    assert cut("lernejestro") == ["lern", "ej", "estr", "o"]
    assert cut("ŝipkapitano") == ["ŝip", "kapitan", "o"]
    assert cut("qwertojn") == ["qwert", "o", "j", "n"] and cut("La") == ["la"] and cut("on") == ["on"]
    p = morphology.DictionaryParser(d).parse("gepatroj")
    assert (p.root, p.prefixes, p.suffixes) == ("patr", ("ge",), ())
    assert morphology.DictionaryParser(d).parse("xyzzo") is None
    table = morphology.TableParser({"ŝipo": morphology.Parse("ŝip", (), ())})
    assert table.parse("Ŝipo").root == "ŝip" and table.parse("domo") is None


def test_content_stems(spark):
    w = spark.createDataFrame([(1, "La"), (1, "malgrandaj"), (1, "malgranda"), (1, "katojn"), (1, None), (2, "kaj")], "doc_id long, word string")
    assert {(r.doc_id, r.stem) for r in morphology.content_stems(w, "doc_id").collect()} == {(1, "malgrand"), (1, "kat")}
    d = morphology.dictionary_of(spark.createDataFrame([("Kat",), (None,)], "root string"))
    assert d.roots == {"kat"}


def test_running_total_in_two_steps(spark):
    rows = [(p, i, (i * 7) % 5) for p in ("a", None) for i in range(300)] + [("b", 1, 2)]
    got = sequences.running_total(spark.createDataFrame(rows, "p string, i int, v int"), "p", "i", "v", "t", ranges=9).collect()
    at = {}
    for p, i, v in rows:
        at[p] = at.get(p, 0) + v
        assert next(r.t for r in got if r.p == p and r.i == i) == at[p]
    assert len(got) == len(rows)


def test_merge_survives_a_run_that_was_broken_off(spark, tmp_path):
    t = str(tmp_path / "t")
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    sinks.merge_small(row(1, "a"), t, "k")
    (tmp_path / "t").rename(tmp_path / "t_before")  # between the two moves
    sinks.merge_small(row(2, "b"), t, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(t).collect()) == [(1, "a"), (2, "b")] and not (tmp_path / "t_before").exists()


def test_a_batch_run_again_writes_nothing_twice(spark, tmp_path):
    from velkora.streaming import live

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = live.read_stream(spark, str(tmp_path / "in"))
    seen = []

    def again(batch, number):
        for _ in range(2):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{number:012d}")
        seen.append(number)

    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(again).start()
    q.awaitTermination()
    assert seen and spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").count() == 10
    assert live.finished(stream, "append").count() == 10


def test_phrases_clauses_and_transitivity():
    from velkora.functions import grammar as G

    ts = G.analyse("La tre granda hundo kaj mia kato kuras en la bela ĝardeno kaj la arbaro, ĉar ili vidas birdojn.")
    texts = lambda spans: [" ".join(t.text for t in ts[a : b + 1]) for a, b in spans]
    assert texts(G.noun_phrases(ts)) == ["la tre granda hundo", "mia kato", "la bela ĝardeno", "la arbaro", "ili", "birdojn"]
    assert sorted(ts[i].text for i in G.in_prepositional(ts)) == ["arbaro", "ĝardeno"]
    assert [" ".join(t.text for t in ts[a:b]) for a, b in G.clauses(ts)] == ["la tre granda hundo kaj mia kato kuras en la bela ĝardeno kaj la arbaro", "ĉar ili vidas birdojn"]
    two = G.analyse("La viro, kiu dormas, sidas sur seĝo kaj la virino kantas")
    assert [two[a].text for a, _ in G.clauses(two)][:2] == ["la", "kiu"] and any(two[a].text == "kaj" for a, _ in G.clauses(two))
    assert G.in_prepositional(two) == {i for i, t in enumerate(two) if t.text == "seĝo"}  # the second noun has a verb of its own
    assert G.transitive("manĝ") and G.transitive("dormig") and G.transitive("remanĝ") and G.transitive("konstru")
    assert G.transitive("dorm") is False and G.transitive("romp") and G.transitive("rompiĝ") is False
    assert G.transitive("xyz") is None and G.transitive("xyz", {"xyz": False}) is False


def test_cap_is_taken_before_the_shuffle(spark):
    from velkora.operators import sampling

    df = sampling.capped(spark.range(1000).withColumn("g", F.col("id") % 2), ["g"], ["id"], 10)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 20


def test_numbers_and_pairs_of_a_hot_part(spark):
    from velkora.functions import facts
    from velkora.operators.sampling import uniform

    rows = [("hot" if i % 3 else None, f"k{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "p string, k string")
    place = F.round(uniform(F.col("k"), "x"), 9)
    got = {r.k: r.n for r in sequences.numbered(df, ["p"], place, "k", "n", ranges=7).collect()}
    order = {r.k: r.u for r in df.select("k", place.alias("u")).collect()}
    for part in ("hot", None):
        ks = sorted((k for p, k in rows if p == part), key=lambda k: (order[k], k))
        assert [got[k] for k in ks] == list(range(len(ks)))
    pairs = facts.neighbours(df, ["p"], "k", "x").collect()
    assert len(pairs) == sum(p == "hot" for p, _ in rows) // 2 + sum(p is None for p, _ in rows) // 2
    assert all(got[r.a.k] + 1 == got[r.b.k] and got[r.a.k] % 2 == 0 for r in pairs)


def test_scenes_are_built_placed_and_filled(spark):
    from velkora.plans import scenes

    b = scenes.Scene().place("kitchen").person("cook", at="kitchen").thing("cupboard", "box", on=("en", "kitchen")).thing("spoon", "thing", hot="yes").scatter("cup", "box", 2, "kitchen").owns("cook", "cup")
    with pytest.raises(ValueError):
        b.thing("knife", "thing", on=("en", "attic"))
    s = b.build(spark, CATALOG)
    assert {r.eid for r in s.entities.collect()} >= {"cup", "cup1"} and s.relations.count() == 5
    assert [r.eid for r in scenes.unplaced(s).where("concept = 'spoon'").collect()] == ["spoon"]
    f = facts_of(spark, [{"relation": "en", "container": {"entity": {"has_suffix": "board"}}, "contained": {"entity": {"hot": "yes"}}}])
    assert [(r.eid, r.relation, r.container) for r in scenes.placements(s, f).collect()] == [("spoon", "en", "cupboard")]
    empty = scenes.Scene().thing("spoon", "thing").build(spark, CATALOG)
    assert [(r.concept, r.eid) for r in scenes.spawned(empty, f).collect()] == [("cupboard", "cupboard_nova")]
    assert scenes.spawned(empty, f, budget=0).count() == 0


def test_ticks_keep_their_memo(spark):
    from velkora.operators.fixpoint import Part, ticks

    s = empty_state(spark, CATALOG, entities=[(1, "p", "cook", "person", None, None), (1, "b", "bell", "box", None, None)])
    echo = Rule("echo", Event("ring", {"theme": X}), None, (Emit("sound", {"theme": X}),))
    act = lambda st, t: st.entities.where("etype = 'person'").select("trace_id", F.lit("ring").alias("action"), F.col("eid").alias("agent"), F.lit("b").alias("theme"))
    out = ticks(s, act, [echo], 3)
    assert {r.action: r.n for r in out.events.groupBy("action").agg(F.count("*").alias("n")).collect()} == {"ring": 3, "sound": 3}
    assert [r.pos for r in out.events.orderBy("pos").collect()] == list(range(6))
    d = derive(empty_state(spark, CATALOG, relations=[(1, "on", "lid", "pot")]), [Derivation("lid", Rel("on", X, Y), (Part(Y, X),))])
    assert [(r.a0, r.a1) for r in d.d_rels.collect()] == [("lid", "pot")]


def test_a_resolver_brings_entities(spark):
    take = planner.Action("take", {"agent": "person"})
    s = empty_state(spark, CATALOG, entities=[(1, "b", "bell", "box", None, None)])
    more = lambda st: st.with_(entities=st.entities.unionByName(spark.createDataFrame([(1, "p", "cook", "person", None, None)], st.entities.schema)))
    assert planner.ground(s, [take]).count() == 0 and planner.ground(s, [take], more).count() == 1

