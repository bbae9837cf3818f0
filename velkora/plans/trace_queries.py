"""Rule, trace and event queries over the trace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import validate
from ..operators.closure import closure, components
from ..operators.fixpoint import AddRelation, Change, ConsumeOne, Derivation, Emit, NotRelation, Property, Relation, RemoveRelation, Rule, TransferN, derive, event_hash, run
from ..operators.rules import ANY, CausedBy, Closure, Compare, Entity, Event, Rel, Same, Var, VarProp, match
from ..operators.state import Catalog, TraceState, load_state
from .queries import query, table

TYPES = {"physical": None, "inanimate": "physical", "artifact": "inanimate", "person": "physical", "location": None}
CATALOG = Catalog(types=TYPES, categories={"kato": ("besto",), "hundo": ("besto",), "birdo": ("besto",), "besto": ("vivaĵo",), "arbo": ("vivaĵo",)}, symmetric=frozenset({"apud"}))
A, B, C, E, X, Y = (Var(n) for n in "abcexy")

# shared views of the SQL twins
PROPS = "props AS (SELECT trace_id, eid, u.key AS slot, unnest(u.value) AS value FROM (SELECT trace_id, eid, unnest(map_entries(properties)) AS u FROM trace_entities))"
REL = "rel AS (SELECT DISTINCT trace_id, relation, args[1] AS a0, args[2] AS a1 FROM trace_relations)"
EV = "ev AS (SELECT DISTINCT ON (trace_id, event_id, pos) trace_id, event_id, pos, action, roles, caused_by, quantity FROM trace_events)"
ROLES = "roles AS (SELECT trace_id, event_id, u.key AS role, u.value AS value FROM (SELECT trace_id, event_id, unnest(map_entries(roles)) AS u FROM ev))"
CAUSES = "causes AS (SELECT trace_id, event_id, unnest(caused_by) AS cause FROM ev)"
SYM = "eff AS (SELECT * FROM rel UNION SELECT trace_id, relation, a1, a0 FROM rel WHERE relation = 'apud')"
LIVE = "live AS (SELECT trace_id, eid, concept, entity_type FROM trace_entities WHERE destroyed_at IS NULL)"


def state(spark: SparkSession, d: str) -> TraceState:
    return load_state(spark, d, CATALOG)


@query(f"WITH {LIVE} SELECT DISTINCT trace_id, eid AS x FROM live WHERE entity_type IN ('physical','inanimate','artifact','person')")
def entity_subtype_filter(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(X, type="physical"))


@query(f"WITH {LIVE} SELECT DISTINCT trace_id, eid AS x FROM live WHERE concept IN ('kato','hundo','birdo','arbo','besto','vivaĵo')")
def entity_category_filter(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(X, category="vivaĵo"))


@query(f"WITH {LIVE} SELECT trace_id, eid AS x FROM live WHERE concept LIKE '%isto'")
def entity_suffix_filter(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(X, has_suffix="isto"))


@query(f"WITH {LIVE}, {PROPS} SELECT trace_id, eid AS x FROM live WHERE EXISTS (SELECT 1 FROM props p WHERE p.trace_id = live.trace_id AND p.eid = live.eid AND slot = 'integrity')")
def slot_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(X, slots={"integrity": ANY}))


@query(f"WITH {LIVE}, {PROPS} SELECT trace_id, eid AS x FROM live WHERE EXISTS (SELECT 1 FROM props p WHERE p.trace_id = live.trace_id AND p.eid = live.eid AND slot = 'temperature' AND value IN ('varma','varmega'))")
def slot_any_of(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(X, slots={"temperature": ("varma", "varmega")}))


@query(f"WITH {LIVE}, {PROPS} SELECT l.trace_id, l.eid AS x, p.value AS y FROM live l JOIN props p ON p.trace_id = l.trace_id AND p.eid = l.eid AND p.slot = 'temperature' WHERE l.concept = 'kato'")
def slot_variable(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(X, concept="kato", slots={"temperature": Y}))


@query(f"WITH {REL}, {SYM} SELECT DISTINCT r.trace_id, r.a0 AS a, r.a1 AS b, s.a1 AS c FROM eff r JOIN eff s ON r.trace_id = s.trace_id AND r.a1 = s.a0 WHERE r.relation = 'en' AND s.relation = 'sur'")
def rel_two_hop_join(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Rel("en", A, B) & Rel("sur", B, C))


@query(f"WITH {REL}, {LIVE} SELECT DISTINCT r.trace_id, r.a0 AS a, r.a1 AS b FROM rel r JOIN live l ON l.trace_id = r.trace_id AND l.eid = r.a1 WHERE r.relation = 'havi' AND l.entity_type = 'person'")
def rel_bound_arg(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(B, type="person") & Rel("havi", A, B)).select("trace_id", "a", "b")


@query(f"WITH {REL}, {SYM} SELECT DISTINCT trace_id, a0 AS a, a1 AS b FROM eff WHERE relation = 'apud'")
def rel_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Rel("apud", A, B))


@query(f"WITH {REL} SELECT DISTINCT trace_id, a1 AS b FROM rel WHERE relation = 'en' AND a0 = 'kato1'")
def rel_literal_arg(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Rel("en", "kato1", B))


@query(f"WITH {REL} SELECT DISTINCT x.trace_id, x.a0 AS a, y.a0 AS b, x.a1 AS c FROM rel x JOIN rel y ON x.trace_id = y.trace_id AND x.a1 = y.a1 WHERE x.relation = 'en' AND y.relation = 'en'")
def colocated_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Rel("en", A, C) & Rel("en", B, C)).select("trace_id", "a", "b", "c")


@query(f"""WITH {LIVE}, {EV}, {ROLES} SELECT DISTINCT e.trace_id, e.event_id AS e, r.value AS a
FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'agent'
WHERE e.action = 'fali' AND NOT EXISTS (SELECT 1 FROM roles t WHERE t.trace_id = e.trace_id AND t.event_id = e.event_id AND t.role = 'theme')""")
def event_role_absent(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Event("fali", {"agent": A}, var=E) & ~Event("fali", {"theme": B}, var=E)).select("trace_id", "e", "a")


@query(f"WITH {REL}, {LIVE} SELECT l.trace_id, l.eid AS x FROM live l WHERE entity_type = 'person' AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.trace_id = l.trace_id AND r.relation = 'havi' AND r.a0 = l.eid)")
def negated_rel_anti(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(X, type="person") & ~Rel("havi", X, Y))


@query(f"WITH {REL} SELECT DISTINCT trace_id, a0 AS a, a1 AS b FROM rel WHERE relation IN ('en','sur')")
def or_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Rel("en", A, B) | Rel("sur", A, B))


@query(f"""WITH {REL}, w AS (SELECT trace_id, eid, CAST(regexp_extract(eid, '(\\d+)$', 1) AS DOUBLE) AS v FROM trace_entities)
SELECT DISTINCT r.trace_id, r.a0 AS a, r.a1 AS b FROM rel r JOIN w p ON p.trace_id = r.trace_id AND p.eid = r.a0 JOIN w q ON q.trace_id = r.trace_id AND q.eid = r.a1
WHERE r.relation = 'sur' AND p.v > q.v""")
def compare_varprop_theta(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    weight = s.entities.select("trace_id", "eid", F.lit("mass").alias("slot"), F.regexp_extract("eid", r"(\d+)$", 1).alias("value"))
    s = s.with_(props=s.props.unionByName(weight))
    return match(s, Rel("sur", A, B) & Compare(VarProp(A, "mass"), ">", VarProp(B, "mass")))


@query(f"""WITH {REL}, w AS (SELECT trace_id, eid, CASE WHEN concept = 'kato' THEN NULL ELSE CAST(regexp_extract(eid, '(\\d+)$', 1) AS DOUBLE) END AS v FROM trace_entities)
SELECT r.trace_id, r.relation, r.a0, r.a1 FROM rel r LEFT JOIN w p ON p.trace_id = r.trace_id AND p.eid = r.a0 LEFT JOIN w q ON q.trace_id = r.trace_id AND q.eid = r.a1
WHERE coalesce(p.v >= q.v, true)""")
def vacuous_numeric_gate(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    size = s.entities.where("concept <> 'kato'").select("trace_id", "eid", F.regexp_extract("eid", r"(\d+)$", 1).alias("value"))
    return validate.numeric_gate(s.relations, size, ">=")


@query(f"WITH {EV}, {CAUSES} SELECT DISTINCT c.trace_id, c.event_id AS x, c.cause AS y FROM causes c JOIN ev f ON f.trace_id = c.trace_id AND f.event_id = c.cause WHERE f.action = 'fali'")
def caused_by_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Event("fali", var=Y) & CausedBy(X, Y)).select("trace_id", "x", "y")


@query(f"""WITH {EV}, {ROLES}, {LIVE} SELECT DISTINCT l.trace_id, l.eid AS a FROM live l WHERE l.entity_type = 'person'
AND NOT EXISTS (SELECT 1 FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'agent' WHERE e.trace_id = l.trace_id AND e.action = 'fali' AND r.value = l.eid)""")
def past_event_guard(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Entity(A, type="person") & ~Event("fali", {"agent": A}))


_STEPS = """WITH RECURSIVE {rel}, e AS (SELECT trace_id, a0 AS s, a1 AS t FROM rel WHERE relation IN ({names}) {and_live}
 UNION SELECT trace_id, a1, a0 FROM rel WHERE relation IN ({names}) {and_live}),
p AS (SELECT trace_id, s, t FROM e WHERE s <> t UNION SELECT p.trace_id, p.s, e.t FROM p JOIN e ON e.trace_id = p.trace_id AND e.s = p.t WHERE e.t <> p.s)
SELECT DISTINCT trace_id, s AS a, t AS b FROM p"""


@query(_STEPS.format(rel=REL, names="'en','sur'", and_live=""))
def closure_undirected(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Closure(("en", "sur"), A, B))


@query(f"""WITH {REL}, e AS (SELECT trace_id, a0 AS s, a1 AS t FROM rel WHERE relation = 'en' UNION SELECT trace_id, a1, a0 FROM rel WHERE relation = 'en'),
two AS (SELECT x.trace_id, x.s, y.t FROM e x JOIN e y ON x.trace_id = y.trace_id AND x.t = y.s)
SELECT DISTINCT trace_id, s AS a, t AS b FROM (SELECT * FROM e UNION SELECT * FROM two) WHERE s <> t""")
def closure_max_steps(spark: SparkSession, d: str) -> DataFrame:
    return match(state(spark, d), Closure(("en",), A, B, max_steps=2))


@query(f"""WITH RECURSIVE {REL}, p AS (SELECT trace_id, a0 AS s, a1 AS t FROM rel WHERE relation = 'en' AND a0 <> a1
UNION SELECT p.trace_id, p.s, r.a1 FROM p JOIN rel r ON r.trace_id = p.trace_id AND r.relation = 'en' AND r.a0 = p.t WHERE r.a1 <> p.s)
SELECT trace_id, s AS src, t AS dst FROM p""")
def reachability_directed(spark: SparkSession, d: str) -> DataFrame:
    r = state(spark, d).relations.where("relation = 'en'").select("trace_id", F.col("a0").alias("src"), F.col("a1").alias("dst"))
    return closure(r, part="trace_id").select("trace_id", "src", "dst")


@query(f"""WITH RECURSIVE {REL}, e AS (SELECT trace_id, a0 AS s, a1 AS t FROM rel UNION SELECT trace_id, a1, a0 FROM rel),
p AS (SELECT trace_id, s, t FROM e UNION SELECT p.trace_id, p.s, e.t FROM p JOIN e ON e.trace_id = p.trace_id AND e.s = p.t)
SELECT trace_id, s AS node, least(min(t), s) AS comp FROM p GROUP BY trace_id, s""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    r = state(spark, d).relations.select("trace_id", F.col("a0").alias("src"), F.col("a1").alias("dst"))
    return components(r, part="trace_id")


@query("""WITH t(type, parent) AS (VALUES ('physical', NULL), ('inanimate','physical'), ('artifact','inanimate'), ('person','physical'), ('location', NULL)),
c(type, ancestor, depth) AS (SELECT type, type, 0 FROM t UNION ALL SELECT type, parent, 1 FROM t WHERE parent IS NOT NULL UNION ALL SELECT 'artifact', 'physical', 2)
SELECT c.type, c.ancestor, CAST(c.depth AS INTEGER) AS depth, count(e.eid) AS n FROM c LEFT JOIN trace_entities e ON e.entity_type = c.type GROUP BY 1, 2, 3""")
def type_closure(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([(c, p) for c, p in TYPES.items() if p], "src string, dst string")
    own = spark.createDataFrame([(c,) for c in TYPES], "type string").select("type", F.col("type").alias("ancestor"), F.lit(0).alias("depth"))
    pairs = closure(edges).select(F.col("src").alias("type"), F.col("dst").alias("ancestor"), "depth").unionByName(own)
    n = table(spark, d, "trace_entities").groupBy(F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))
    return pairs.join(n, "type", "left").select("type", "ancestor", "depth", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""WITH RECURSIVE {REL}, base AS (SELECT trace_id, a0, a1 FROM rel WHERE relation = 'en'),
p AS (SELECT trace_id, a0, a1, 1 AS k FROM base UNION SELECT p.trace_id, p.a0, b.a1, p.k + 1 FROM p JOIN base b ON b.trace_id = p.trace_id AND b.a0 = p.a1 WHERE p.k < 10)
SELECT DISTINCT p.trace_id, l.a0 AS a, p.a1 AS b FROM p JOIN rel l ON l.trace_id = p.trace_id AND l.relation = 'portas' AND l.a1 = p.a0""")
def second_order_contains(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    inner = closure(s.relations.where("relation = 'en'").select("trace_id", F.col("a0").alias("src"), F.col("a1").alias("dst")), part="trace_id")
    loops = s.relations.where("relation = 'en' and a0 = a1").select("trace_id", F.col("a0").alias("src"), F.col("a1").alias("dst"))
    inner = inner.select("trace_id", "src", "dst").unionByName(loops)
    # a node on a cycle contains itself: pairs (x, x) over two or more edges
    back = inner.join(s.relations.where("relation = 'en'").select("trace_id", F.col("a0").alias("dst"), F.col("a1").alias("src")), ["trace_id", "src", "dst"]).select("trace_id", "src").distinct()
    inner = inner.unionByName(back.select("trace_id", "src", F.col("src").alias("dst"))).distinct()
    top = s.relations.where("relation = 'portas'").select("trace_id", F.col("a0").alias("a"), F.col("a1").alias("src"))
    return top.join(inner, ["trace_id", "src"]).select("trace_id", "a", F.col("dst").alias("b")).distinct()


# ---------------------------------------------------------------- derivations

HOT = Derivation("hot", Entity(X, slots={"temperature": "varmega"}, alive=False), (Property(X, "danger", "jes"),))
SAFE = Derivation("safe", Entity(X, slots={"temperature": ANY}, alive=False), (Property(X, "danger", "ne"),))


@query(f"WITH {PROPS} SELECT DISTINCT trace_id, eid, 'danger' AS slot, CASE WHEN value = 'varmega' THEN 'jes' ELSE 'ne' END AS value FROM props WHERE slot = 'temperature'")
def derive_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return derive(state(spark, d), [HOT, SAFE]).d_props


@query(f"WITH {PROPS} SELECT DISTINCT trace_id, eid, 'integrity' AS slot, 'nekonata' AS value FROM props a WHERE slot = 'temperature' AND NOT EXISTS (SELECT 1 FROM props b WHERE b.trace_id = a.trace_id AND b.eid = a.eid AND b.slot = 'integrity')")
def derive_asserted_wins(spark: SparkSession, d: str) -> DataFrame:
    rule = Derivation("unknown", Entity(X, slots={"temperature": ANY}, alive=False), (Property(X, "integrity", "nekonata"),))
    return derive(state(spark, d), [rule]).d_props


@query(f"WITH RECURSIVE {REL}, p AS (SELECT trace_id, a0, a1 FROM rel WHERE relation = 'en' UNION SELECT p.trace_id, p.a0, r.a1 FROM p JOIN rel r ON r.trace_id = p.trace_id AND r.relation = 'en' AND r.a0 = p.a1) SELECT trace_id, 'ene' AS relation, a0, a1 FROM p")
def derive_chain_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        Derivation("base", Rel("en", A, B), (Relation("ene", A, B),)),
        Derivation("step", Rel("ene", A, B) & Rel("en", B, C), (Relation("ene", A, C),)),
    ]
    return derive(state(spark, d), rules).d_rels


@query(f"""WITH {REL}, {PROPS}, gone AS (SELECT DISTINCT r.trace_id, r.relation, r.a0, r.a1 FROM rel r JOIN props p ON p.trace_id = r.trace_id AND p.eid = r.a0 AND p.slot = 'integrity' AND p.value = 'rompita' WHERE r.relation = 'portas')
SELECT * FROM (SELECT trace_id, relation, a0, a1 FROM rel UNION SELECT trace_id, relation, a1, a0 FROM rel WHERE relation = 'apud') EXCEPT SELECT * FROM gone""")
def derive_removal_mask(spark: SparkSession, d: str) -> DataFrame:
    rule = Derivation("broken", Rel("portas", A, B) & Entity(A, slots={"integrity": "rompita"}, alive=False), (NotRelation("portas", A, B),))
    return derive(state(spark, d), [rule]).eff_rel()


@query(f"WITH {REL} SELECT DISTINCT trace_id, 'enhavas' AS relation, a1 AS a0, a0 AS a1 FROM rel WHERE relation = 'en'")
def derive_reversal(spark: SparkSession, d: str) -> DataFrame:
    return derive(state(spark, d), [Derivation("inverse", Rel("en", A, B), (Relation("enhavas", B, A),))]).d_rels


@query(f"WITH {REL}, {PROPS} SELECT DISTINCT r.trace_id, r.a1 AS eid, 'odoro' AS slot, p.value FROM rel r JOIN props p ON p.trace_id = r.trace_id AND p.eid = r.a0 AND p.slot = 'temperature' WHERE r.relation = 'en'")
def derive_multivalued(spark: SparkSession, d: str) -> DataFrame:
    s = load_state(spark, d, Catalog(types=TYPES, multi_valued=frozenset({"odoro"})))
    rule = Derivation("smell", Rel("en", A, B) & Entity(A, slots={"temperature": Y}, alive=False), (Property(B, "odoro", Y),))
    return derive(s, [rule]).d_props


# ---------------------------------------------------------------- event calculus


def with_changes(spark: SparkSession, d: str) -> TraceState:
    """Falling breaks, washing cools: property changes of the stored events."""
    s = state(spark, d)
    verbs = spark.createDataFrame([("fali", "integrity", "rompita"), ("lavi", "temperature", "malvarma"), ("bruli", "temperature", "varmega")], "action string, slot string, value string")
    theme = s.roles.where("role = 'theme'").select("trace_id", "event_id", F.col("value").alias("eid"))
    ch = s.events.join(verbs, "action").join(theme, ["trace_id", "event_id"]).select("trace_id", "pos", "eid", "slot", "value").distinct()
    return s.with_(changes=ch)


CHANGES = """changes AS (SELECT DISTINCT e.trace_id, e.pos, r.value AS eid, v.slot, v.value FROM ev e JOIN (VALUES ('fali','integrity','rompita'),('lavi','temperature','malvarma'),('bruli','temperature','varmega')) v(action, slot, value) ON v.action = e.action
JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'theme')"""


@query(f"""WITH {PROPS}, {EV}, {ROLES}, {CHANGES}, asks AS (SELECT trace_id, eid, slot, t FROM (SELECT trace_id, eid, created_at FROM trace_entities), (VALUES ('integrity'),('temperature')) s(slot), (VALUES (3),(6)) q(t))
SELECT a.trace_id, a.eid, a.slot, a.t, CASE WHEN coalesce(e.created_at < a.t, true) THEN coalesce(
 (SELECT max_by(c.value, c.pos) FROM changes c WHERE c.trace_id = a.trace_id AND c.eid = a.eid AND c.slot = a.slot AND c.pos < a.t),
 (SELECT min(p.value) FROM props p WHERE p.trace_id = a.trace_id AND p.eid = a.eid AND p.slot = a.slot)) END AS value
FROM asks a JOIN trace_entities e ON e.trace_id = a.trace_id AND e.eid = a.eid""")
def property_at_asof(spark: SparkSession, d: str) -> DataFrame:
    s = with_changes(spark, d)
    asks = s.entities.select("trace_id", "eid", F.explode(F.array(F.lit("integrity"), F.lit("temperature"))).alias("slot")).select("*", F.explode(F.array(F.lit(3), F.lit(6))).alias("t"))
    return ev.property_at(s.changes, s.props, asks, s.entities)


@query("SELECT trace_id, eid FROM trace_entities WHERE coalesce(created_at < 5, true) AND coalesce(destroyed_at >= 5, true)")
def entities_at_interval(spark: SparkSession, d: str) -> DataFrame:
    return ev.entities_at(state(spark, d).entities, 5).select("trace_id", "eid")


@query(f"""WITH {PROPS}, {EV}, {ROLES}, {CHANGES}, last AS (SELECT trace_id, eid, slot, max_by(value, pos) AS value FROM changes GROUP BY ALL)
SELECT * FROM last UNION ALL SELECT trace_id, eid, slot, value FROM props p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.trace_id = p.trace_id AND l.eid = p.eid AND l.slot = p.slot)""")
def current_state(spark: SparkSession, d: str) -> DataFrame:
    return with_changes(spark, d).current_props()


@query(f"""WITH RECURSIVE {EV}, {CAUSES}, ed AS (SELECT DISTINCT c.trace_id, c.event_id, c.cause FROM causes c JOIN ev e ON e.trace_id = c.trace_id AND e.event_id = c.cause),
p AS (SELECT DISTINCT trace_id, event_id, 0 AS depth FROM ev UNION SELECT ed.trace_id, ed.event_id, p.depth + 1 FROM p JOIN ed ON ed.trace_id = p.trace_id AND ed.cause = p.event_id)
SELECT trace_id, event_id, max(depth) AS depth FROM p GROUP BY 1, 2""")
def causal_depth(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return ev.causal_depth(s.events, s.causes)


@query(f"""WITH RECURSIVE {EV}, {CAUSES}, ed AS (SELECT DISTINCT trace_id, event_id, cause FROM causes),
p AS (SELECT trace_id, event_id, 1 AS depth FROM ed UNION ALL SELECT ed.trace_id, ed.event_id, p.depth + 1 FROM p JOIN ed ON ed.trace_id = p.trace_id AND ed.cause = p.event_id WHERE p.depth < 12)
SELECT depth, count(*) AS n_paths FROM p GROUP BY 1""")
def causal_paths(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return ev.chain_paths(s.events, s.causes)


@query(f"""WITH {EV}, {CAUSES}, one AS (SELECT c.trace_id, c.event_id, min(f.action) AS src FROM causes c JOIN ev f ON f.trace_id = c.trace_id AND f.event_id = c.cause GROUP BY 1, 2)
SELECT action, CASE WHEN src IS NULL THEN 'seed' ELSE src || ' → ' || action END AS inferred, count(*) AS n FROM ev LEFT JOIN one USING (trace_id, event_id) GROUP BY 1, 2""")
def rule_attribution(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return ev.rule_attribution(s.events, s.causes)


@query(f"""WITH {EV}, t AS (SELECT trace_id, event_id, action, quantity, list_sort(list_transform(map_entries(roles), lambda x: x.key || '=' || x.value)) AS rs, list_sort(caused_by) AS cs FROM ev)
SELECT trace_id, event_id, left(sha1(action || '|' || array_to_string(rs, ',') || '|' || array_to_string(cs, ',') || CASE WHEN quantity IS NOT NULL AND quantity <> 1 THEN '|' || CAST(quantity AS VARCHAR) ELSE '' END), 12) AS hash FROM t""")
def event_content_hash(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "trace_events").dropDuplicates(["trace_id", "event_id", "pos"])
    texts = F.transform(F.map_entries("roles"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return v.select("trace_id", "event_id", event_hash(F.col("action"), texts, F.col("caused_by"), F.col("quantity")).alias("hash"))


# ---------------------------------------------------------------- effects

BREAK = Rule("break", Event("fali", {"theme": X}), Entity(X, type="artifact", alive=False), (Emit("rompiĝi", {"theme": X}, (Change(X, "integrity", "rompita"),)),))
SPILL = Rule("spill", Event("rompiĝi", {"theme": X}), Rel("en", Y, X), (Emit("elfali", {"theme": Y}),))


@query(f"""WITH {EV}, {ROLES}, {REL}, brk AS (SELECT DISTINCT e.trace_id, e.event_id AS cause, r.value AS x, left(sha1('rompiĝi|theme=' || r.value || '|' || e.event_id), 12) AS id FROM ev e
 JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'theme' JOIN trace_entities t ON t.trace_id = e.trace_id AND t.eid = r.value AND t.entity_type = 'artifact' WHERE e.action = 'fali'),
spl AS (SELECT DISTINCT b.trace_id, left(sha1('elfali|theme=' || r.a0 || '|' || b.id), 12) AS id FROM brk b JOIN rel r ON r.trace_id = b.trace_id AND r.relation = 'en' AND r.a1 = b.x)
SELECT trace_id, 'rompiĝi' AS action, id AS event_id FROM (SELECT DISTINCT trace_id, id FROM brk) UNION ALL SELECT trace_id, 'elfali', id FROM spl""")
def emit_cascade(spark: SparkSession, d: str) -> DataFrame:
    return run(state(spark, d), [BREAK, SPILL]).events.where("action in ('rompiĝi', 'elfali')").select("trace_id", "action", "event_id")


@query(f"""WITH {EV}, {ROLES} SELECT e.trace_id, e.event_id AS _event, r.value AS x FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'theme' WHERE e.action = 'fali'
UNION SELECT e.trace_id, e.event_id, r.value FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'agent' WHERE e.action = 'fali'""")
def for_each_explode(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    # the two roles as one list role, taken element by element
    listed = s.roles.where("role in ('theme', 'agent')").withColumn("role", F.lit("parts"))
    falls = s.events.where("action = 'fali'").select("trace_id", F.col("event_id").alias("_event"))
    from ..operators.fixpoint import for_each

    return for_each(falls, listed, "parts", X).select("trace_id", "_event", "x").distinct()


def _stacks(spark: SparkSession, d: str) -> TraceState:
    """Things have a count that follows from their number in the trace (0 for persons: none)."""
    s = state(spark, d)
    n = s.entities.where("etype is null or etype <> 'person'").select("trace_id", "eid", F.lit("count").alias("slot"), F.regexp_extract("eid", r"(\d+)$", 1).alias("value"))
    return s.with_(props=s.props.unionByName(n))


@query(f"""WITH {EV}, {ROLES}, n AS (SELECT trace_id, eid, CASE WHEN entity_type IS DISTINCT FROM 'person' THEN CAST(regexp_extract(eid, '(\\d+)$', 1) AS INTEGER) END AS c, destroyed_at FROM trace_entities),
b AS (SELECT DISTINCT e.trace_id, r.value AS eid FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'theme' WHERE e.action = 'preni')
SELECT n.trace_id, n.eid, CASE WHEN c > 1 THEN CAST(c - 1 AS VARCHAR) END AS left_over, (n.destroyed_at IS NOT NULL OR c IS NULL OR c <= 1) AS gone FROM b JOIN n USING (trace_id, eid)""")
def consume_one(spark: SparkSession, d: str) -> DataFrame:
    s = _stacks(spark, d)
    taken = s.events.where("action = 'preni'").select("trace_id", "event_id").join(s.roles.where("role = 'theme'"), ["trace_id", "event_id"]).select("trace_id", F.col("value").alias("eid")).distinct()
    after = run(s, [Rule("eat", Event("preni", {"theme": X}), None, (ConsumeOne(X),))], max_rounds=1)
    now = after.changes.where("slot = 'count'").groupBy("trace_id", "eid").agg(F.max_by("value", "pos").alias("left_over"))
    return taken.join(after.entities, ["trace_id", "eid"]).join(now, ["trace_id", "eid"], "left").select("trace_id", "eid", "left_over", F.col("destroyed_at").isNotNull().alias("gone"))


@query(f"""WITH {EV}, {ROLES}, n AS (SELECT trace_id, eid, CAST(regexp_extract(eid, '(\\d+)$', 1) AS INTEGER) AS c FROM trace_entities WHERE entity_type IS DISTINCT FROM 'person'),
b AS (SELECT DISTINCT e.trace_id, e.event_id, t.value AS x, a.value AS y FROM ev e JOIN roles t ON t.trace_id = e.trace_id AND t.event_id = e.event_id AND t.role = 'theme'
 JOIN roles a ON a.trace_id = e.trace_id AND a.event_id = e.event_id AND a.role = 'agent' WHERE e.action = 'sendi')
SELECT b.trace_id, b.y AS a0, CASE WHEN n.c > 2 THEN b.x || '_' || b.y || '_' || b.event_id ELSE b.x END AS a1 FROM b LEFT JOIN n ON n.trace_id = b.trace_id AND n.eid = b.x""")
def transfer_n_split(spark: SparkSession, d: str) -> DataFrame:
    s = _stacks(spark, d)
    s = s.with_(relations=s.relations.where("relation <> 'havi'"))
    after = run(s, [Rule("send", Event("sendi", {"theme": X, "agent": Y}), None, (TransferN(X, Y, 2),))], max_rounds=1)
    return after.relations.where("relation = 'havi'").select("trace_id", "a0", "a1")


@query(f"""WITH {EV}, {ROLES}, {REL}, b AS (SELECT DISTINCT e.trace_id, r.value AS x FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'theme' WHERE e.action = 'fermi')
SELECT trace_id, relation, a0, a1 FROM rel WHERE NOT (relation = 'en' AND EXISTS (SELECT 1 FROM b WHERE b.trace_id = rel.trace_id AND b.x = rel.a1))
UNION SELECT b.trace_id, 'fermita', r.a0, b.x FROM b JOIN rel r ON r.trace_id = b.trace_id AND r.relation = 'en' AND r.a1 = b.x""")
def add_remove_relation(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("close", Event("fermi", {"theme": X}), Rel("en", Y, X), (AddRelation("fermita", Y, X), RemoveRelation("en", Y, X)))
    return run(state(spark, d), [rule], max_rounds=1).relations.distinct()


@query(f"""WITH {REL}, t AS (SELECT trace_id, eid, entity_type FROM trace_entities)
SELECT r.trace_id, r.relation, r.a0, r.a1, CASE WHEN p.eid IS NULL OR q.eid IS NULL THEN 'unknown entity'
 WHEN r.relation = 'havi' AND p.entity_type IS DISTINCT FROM 'person' THEN 'argument type' WHEN r.relation = 'portas' AND (p.entity_type IS DISTINCT FROM 'person') THEN 'argument type'
 WHEN r.a0 = r.a1 THEN 'same argument' END AS reason FROM rel r LEFT JOIN t p ON p.trace_id = r.trace_id AND p.eid = r.a0 LEFT JOIN t q ON q.trace_id = r.trace_id AND q.eid = r.a1""")
def validate_relation_reason(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    schema = {"havi": ("person", None), "portas": ("person", None), "en": (None, None), "sur": (None, None), "apud": (None, None)}
    return validate.relation_reasons(s.relations, s.entities, schema, CATALOG)


@query("""WITH fact(ord, container, contained, relation) AS (VALUES (0,'location','person','en'),(1,'location','artifact','en'),(2,'artifact','artifact','sur'),(3,'location','artifact','sur')),
c AS (SELECT DISTINCT concept, entity_type FROM trace_entities WHERE entity_type IS NOT NULL), pairs AS (SELECT a.concept AS container, b.concept AS contained, f.relation, f.ord FROM fact f JOIN c a ON a.entity_type = f.container JOIN c b ON b.entity_type = f.contained)
SELECT contained, container, min_by(relation, ord) AS relation FROM pairs GROUP BY 1, 2""")
def inverse_containment(spark: SparkSession, d: str) -> DataFrame:
    facts = [(0, "location", "person", "en"), (1, "location", "artifact", "en"), (2, "artifact", "artifact", "sur"), (3, "location", "artifact", "sur")]
    c = table(spark, d, "trace_entities").where("entity_type is not null").select("concept", "entity_type").distinct()
    return validate.inverse_containment(validate.containment_pairs(c, facts))


@query(f"""WITH {REL}, need AS (SELECT DISTINCT trace_id, eid FROM trace_entities WHERE entity_type = 'artifact')
SELECT n.trace_id, n.eid, NOT EXISTS (SELECT 1 FROM rel r WHERE r.trace_id = n.trace_id AND r.a0 = n.eid AND r.relation IN ('en','sur')) AS violated FROM need n""")
def required_violation(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return validate.required_violation(s.entities.where("etype = 'artifact'"), s.relations, ("en", "sur"))


@query(f"""WITH RECURSIVE {REL}, first AS (SELECT trace_id, a0, min(a1) AS a1 FROM rel WHERE relation IN ('en','sur') AND a0 <> a1 GROUP BY 1, 2),
p AS (SELECT trace_id, a0 AS eid, a1 AS up, 1 AS depth, [a0, a1] AS seen FROM first UNION ALL SELECT p.trace_id, p.eid, f.a1, p.depth + 1, list_append(p.seen, f.a1) FROM p JOIN first f ON f.trace_id = p.trace_id AND f.a0 = p.up WHERE NOT list_contains(p.seen, f.a1) AND p.depth < 20)
SELECT trace_id, eid, up, depth FROM p""")
def container_chain(spark: SparkSession, d: str) -> DataFrame:
    return validate.container_chain(state(spark, d).relations.where("relation in ('en', 'sur')"))


@query(f"WITH {REL}, {EV}, {ROLES} SELECT e.trace_id, e.eid FROM trace_entities e WHERE e.entity_type = 'person' AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.trace_id = e.trace_id AND r.value = e.eid)")
def unused_persons(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    used = s.roles.select("trace_id", F.col("value").alias("eid")).distinct()
    return s.entities.where("etype = 'person'").join(used, ["trace_id", "eid"], "left_anti").select("trace_id", "eid")


# ---------------------------------------------------------------- sequences of a trace


@query(f"""WITH {EV}, s AS (SELECT trace_id, pos, event_id, action, coalesce(roles['agent'], '') AS agent, CASE WHEN coalesce(roles['agent'], '') IS DISTINCT FROM lag(coalesce(roles['agent'], '')) OVER (PARTITION BY trace_id ORDER BY pos, event_id) THEN 1 ELSE 0 END AS new FROM ev),
i AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT trace_id, CAST(island AS BIGINT) AS island, agent, count(*) AS n, min(pos) AS first_pos, string_agg(action, ' ' ORDER BY pos, event_id) AS actions FROM i GROUP BY 1, 2, 3""")
def same_subject_islands(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sequences import islands

    v = table(spark, d, "trace_events").dropDuplicates(["trace_id", "event_id", "pos"])
    v = v.withColumn("agent", F.coalesce(F.try_element_at("roles", F.lit("agent")), F.lit("")))
    i = islands(v, "trace_id", ["pos", "event_id"], "agent")
    return i.groupBy("trace_id", "island", "agent").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id", "action"))), lambda x: x["action"]), " ").alias("actions"))


@query(f"""WITH {EV}, s AS (SELECT trace_id, pos, event_id, action, lag(action) OVER (PARTITION BY trace_id ORDER BY pos, event_id) AS prev FROM ev) SELECT trace_id, pos, event_id, action FROM s WHERE prev IS DISTINCT FROM action""")
def adjacent_dedup(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sequences import adjacent_distinct

    v = table(spark, d, "trace_events").dropDuplicates(["trace_id", "event_id", "pos"]).select("trace_id", "pos", "event_id", "action")
    return adjacent_distinct(v, "trace_id", ["pos", "event_id"], "action")


@query(f"WITH {EV}, {ROLES} SELECT r.trace_id, r.value AS eid, min(e.pos) AS first_pos FROM roles r JOIN ev e USING (trace_id, event_id) GROUP BY 1, 2")
def first_reference(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return s.roles.join(s.events, ["trace_id", "event_id"]).groupBy("trace_id", F.col("value").alias("eid")).agg(F.min("pos").alias("first_pos"))


@query(f"""WITH {REL} SELECT trace_id, relation, a1 AS container, count(*) AS n, string_agg(a0, ', ' ORDER BY a0) AS members FROM rel WHERE relation IN ('en','sur') GROUP BY 1, 2, 3""")
def group_by_container(spark: SparkSession, d: str) -> DataFrame:
    r = state(spark, d).relations.where("relation in ('en', 'sur')")
    return r.groupBy("trace_id", "relation", F.col("a1").alias("container")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("a0")), ", ").alias("members"))


@query(f"""WITH {REL}, n AS (SELECT trace_id, a1 AS container, count(*) AS cnt FROM rel WHERE relation = 'en' GROUP BY 1, 2) SELECT trace_id, arg_max(container, (cnt, -ascii(container), container)) AS scene FROM (SELECT * FROM n) GROUP BY 1""")
def inferred_scene(spark: SparkSession, d: str) -> DataFrame:
    r = state(spark, d).relations.where("relation = 'en'")
    n = r.groupBy("trace_id", F.col("a1").alias("container")).agg(F.count("*").alias("cnt"))
    return n.groupBy("trace_id").agg(F.max_by("container", F.struct("cnt", -F.ascii("container"), "container")).alias("scene"))


@query(f"""WITH {REL}, {EV}, {ROLES}, gone AS (SELECT DISTINCT e.trace_id, r.value AS eid FROM ev e JOIN roles r USING (trace_id, event_id) WHERE e.action = 'preni' AND r.role = 'theme')
SELECT trace_id, relation, a0, a1, 'removed' AS change FROM rel WHERE relation = 'en' AND EXISTS (SELECT 1 FROM gone g WHERE g.trace_id = rel.trace_id AND g.eid = rel.a0)
UNION ALL SELECT g.trace_id, 'prenita', g.eid, 'trace', 'added' FROM gone g""")
def relation_diff(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sequences import set_diff

    s = state(spark, d)
    gone = s.events.where("action = 'preni'").join(s.roles.where("role = 'theme'"), ["trace_id", "event_id"]).select("trace_id", F.col("value").alias("eid")).distinct()
    before = s.relations
    taken = before.join(gone.withColumnRenamed("eid", "a0"), ["trace_id", "a0"], "left_semi").where("relation = 'en'")
    after = before.exceptAll(taken.select(*before.columns)).unionByName(gone.select("trace_id", F.lit("prenita").alias("relation"), F.col("eid").alias("a0"), F.lit("trace").alias("a1")))
    return set_diff(before, after)


@query(f"""WITH {EV} SELECT action, coalesce(roles['theme'] IS NOT NULL, false) AS with_theme, count(*) AS n FROM ev GROUP BY 1, 2""")
def verb_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "trace_events").dropDuplicates(["trace_id", "event_id", "pos"])
    return v.groupBy("action", F.try_element_at("roles", F.lit("theme")).isNotNull().alias("with_theme")).agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, t AS (SELECT trace_id, string_agg(action, '→' ORDER BY pos, event_id) AS plan FROM ev GROUP BY 1), g AS (SELECT plan, count(*) AS n FROM t GROUP BY 1)
SELECT count(*) AS n_skeletons, sum(n)::BIGINT AS n_plans, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS repeated FROM g""")
def skeleton_diversity(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "trace_events").dropDuplicates(["trace_id", "event_id", "pos"])
    t = v.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id", "action"))), lambda x: x["action"]), "→").alias("plan"))
    g = t.groupBy("plan").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_skeletons"), F.sum("n").alias("n_plans"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"))


@query(f"""WITH {EV}, s AS (SELECT trace_id, action, lead(action) OVER (PARTITION BY trace_id ORDER BY pos, event_id) AS nxt FROM ev) SELECT action, nxt, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def chain_counts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "trace_events").dropDuplicates(["trace_id", "event_id", "pos"])
    w = W.partitionBy("trace_id").orderBy("pos", "event_id")
    return v.withColumn("nxt", F.lead("action").over(w)).where("nxt is not null").groupBy("action", "nxt").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, s AS (SELECT trace_id, pos, event_id, array_length(list_distinct(list(action) OVER (PARTITION BY trace_id ORDER BY pos, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))) AS recent FROM ev) SELECT trace_id, pos, event_id, coalesce(recent, 0)::INTEGER AS recent FROM s""")
def recency_window(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "trace_events").dropDuplicates(["trace_id", "event_id", "pos"])
    w = W.partitionBy("trace_id").orderBy("pos", "event_id").rowsBetween(-3, -1)
    return v.select("trace_id", "pos", "event_id", F.size(F.collect_set("action").over(w)).alias("recent"))
