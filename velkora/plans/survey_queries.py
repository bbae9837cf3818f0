"""Further operators over the fact, question and trace tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import facts as T
from ..functions.text import agree
from ..operators import registry, sampling
from ..operators.fixpoint import Derivation, Property, derive
from ..operators.rules import Entity, Rel, Var
from ..operators.state import REL as REL_SCHEMA
from ..operators.state import TraceState
from ..operators.validate import RelationSchema, checked_relations, containment_facts, reachable_concepts
from ..sources import sinks
from ..streaming.live import shared_folder
from . import planner, scenes
from .agent_queries import TAKE
from .fact_queries import CL, U, USABLE, claims, ok
from .queries import ORACLE, QUERIES, query, table
from .trace_queries import CATALOG, EV, PROPS, REL, ROLES, state

X, Y, Z = Var("x"), Var("y"), Var("z")


def _in(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _any(col: str, xs) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{x}')" for x in xs) + ")"


# ---------------------------------------------------------------- facts


@query(f"""WITH {CL}, p AS (SELECT DISTINCT entity_id FROM cl WHERE property = 'dato de naskiĝo')
SELECT entity_id, pos, property, value, coalesce(property = 'estas' AND ((entity_id IN (SELECT entity_id FROM p) AND {_any('value', T.TRIVIAL_CLASSES)}) OR len(list_filter(regexp_split_to_array(trim(value), '\\s+'), lambda w: w <> '')) > 5), false) AS trivial FROM cl WHERE property IS NOT NULL""")
def trivial_class_filter(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("property is not null")
    person = c.where("property = 'dato de naskiĝo'").select("entity_id").distinct().withColumn("person", F.lit(True))
    return c.join(person, "entity_id", "left").select("entity_id", "pos", "property", "value", T.trivial_class(F.col("property"), F.col("value"), F.coalesce("person", F.lit(False))).alias("trivial"))


@query(f"WITH {CL} SELECT entity_id, max(coalesce({_any('value', T.ABSTRACT)}, false)) AS abstract, max(coalesce({_any('value', T.INVENTIONS)}, false)) AS invention FROM cl WHERE property = 'estas' GROUP BY 1")
def abstract_invention_tests(spark: SparkSession, d: str) -> DataFrame:
    return T.class_tests(claims(spark, d))


@query("SELECT item_id, regexp_replace(label || CASE WHEN length(label) % 2 = 0 THEN ' lingvo' ELSE ' Lingvo' END, ' [lL]ingvo$', '') AS name FROM fact_items WHERE kind = 'lingvo'")
def strip_language_suffix(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat("label", F.when(F.length("label") % 2 == 0, " lingvo").otherwise(" Lingvo"))
    return table(spark, d, "fact_items").where("kind = 'lingvo'").select("item_id", T.strip_language(full).alias("name"))


@query(f"""WITH {CL}, k AS (SELECT entity_id, pos, lower(value) AS k FROM cl WHERE property = 'estas')
SELECT entity_id, coalesce(min_by(k, (pos, k)) FILTER (WHERE k IN ({_in(T.SETTLEMENTS)})), 'loko') AS kind FROM k GROUP BY 1""")
def superlative_kind(spark: SparkSession, d: str) -> DataFrame:
    return T.settlement_kind(claims(spark, d))


@query(f"WITH {CL}, {USABLE}, n AS (SELECT entity_id, count(*) AS n FROM ok GROUP BY 1) SELECT entity_id, unnest(generate_series(1, CASE WHEN n < 5 THEN 1 ELSE 3 END))::INTEGER AS variant FROM n")
def text_variants(spark: SparkSession, d: str) -> DataFrame:
    return T.variants(ok(spark, d).groupBy("entity_id").agg(F.count("*").alias("n_facts")))


@query("""WITH q AS (SELECT item_id, category, answer[1] AS a, regexp_extract(question, 'ĉefurbo de ([\\p{L}\\p{N}_][\\p{L}\\p{N}_-]*)', 1) AS c, regexp_extract(question, '(?:Kiom|Kio) estas (.+?)\\?', 1) AS x FROM factual_qa WHERE len(answer) > 0)
SELECT item_id, CASE category WHEN 'ĉefurbo' THEN CASE WHEN c <> '' THEN 'La ĉefurbo de ' || c || ' estas ' || a || '.' ELSE 'La ĉefurbo estas ' || a || '.' END
 WHEN 'aritmetiko' THEN CASE WHEN x <> '' THEN x || ' = ' || a || '.' ELSE 'Estas ' || a || '.' END ELSE 'La respondo estas ' || a || '.' END AS gold FROM q""")
def structured_gold(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "factual_qa").where(F.size("answer") > 0)  # the first answer is the primary one
    return q.select("item_id", T.structured_gold(F.col("category"), F.col("question"), F.get("answer", F.lit(0))).alias("gold"))


@query(f"""WITH {CL}, y AS (SELECT c.entity_id, e.label, e.class_id, min(value) AS founded FROM cl c JOIN fact_entities e USING (entity_id) WHERE property = 'dato de fondo' AND value <> '' GROUP BY ALL),
b AS (SELECT *, floor({U.format('entity_id', 'partner')} * 64) AS b FROM y), p AS (SELECT *, coalesce(lead(entity_id) OVER (PARTITION BY class_id, b ORDER BY entity_id), min(entity_id) OVER (PARTITION BY class_id, b)) AS partner FROM b)
SELECT p.entity_id, p.partner, CASE WHEN {U.format('p.entity_id', 'order')} < 0.5 THEN 'Kio estas pli malnova, ' || p.label || ' aŭ ' || y.label || '?' ELSE 'Ĉu ' || p.label || ' fondiĝis antaŭ ' || y.label || '?' END AS question,
 CASE WHEN p.founded < y.founded THEN p.label WHEN p.founded > y.founded THEN y.label ELSE 'samaĝaj' END AS answer FROM p JOIN y ON y.entity_id = p.partner WHERE p.entity_id <> p.partner""")
def comparison_followup(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("property = 'dato de fondo' and value <> ''")
    y = c.join(table(spark, d, "fact_entities").select("entity_id", "label", "class_id"), "entity_id").groupBy("entity_id", "label", "class_id").agg(F.min("value").alias("founded"))
    p = T.partners(y, "class_id", "entity_id")
    me = y.select("entity_id", F.col("label").alias("a"), F.col("founded").alias("fa"))
    other = y.select(F.col("entity_id").alias("partner"), F.col("label").alias("b"), F.col("founded").alias("fb"))
    j = p.select("entity_id", "partner").join(me, "entity_id").join(other, "partner")
    older = F.concat(F.lit("Kio estas pli malnova, "), "a", F.lit(" aŭ "), "b", F.lit("?"))
    yes_no = F.concat(F.lit("Ĉu "), "a", F.lit(" fondiĝis antaŭ "), "b", F.lit("?"))
    first = F.round(sampling.uniform(F.col("entity_id"), "order"), 9) < 0.5
    answer = F.when(F.col("fa") < F.col("fb"), F.col("a")).when(F.col("fa") > F.col("fb"), F.col("b")).otherwise("samaĝaj")
    return j.select("entity_id", "partner", F.when(first, older).otherwise(yes_no).alias("question"), answer.alias("answer"))


@query(f"SELECT 'single' AS kind, count(*) AS n FROM ({ORACLE['single_turn_qa']}) UNION ALL SELECT 'multi', count(*) FROM ({ORACLE['multi_turn_qa']}) UNION ALL SELECT 'superlative', count(*) FROM ({ORACLE['superlatives']})")
def sft_sink(spark: SparkSession, d: str) -> DataFrame:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.cast("string").alias("content"))
    single = QUERIES["single_turn_qa"](spark, d).select(F.concat_ws("|", "entity_id", "seq").alias("id"), F.array(turn("user", F.col("question")), turn("assistant", F.col("answer"))).alias("messages"))
    multi = QUERIES["multi_turn_qa"](spark, d).select(F.col("entity_id").alias("id"), F.array(turn("chat", F.col("chat"))).alias("messages"))
    best = QUERIES["superlatives"](spark, d).select(F.col("class_id").alias("id"), F.array(turn("user", F.lit("Kiu estas la plej granda?")), turn("assistant", F.col("most"))).alias("messages"))
    path = f"{shared_folder(spark)}/sft"
    sinks.conversations({"single": single, "multi": multi, "superlative": best}, path)
    return spark.read.schema("id string, messages array<struct<role:string,content:string>>, kind string").json(path).groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- traces: counts and maps


@query(f"""WITH {REL}, {PROPS}, c AS (SELECT trace_id, eid, min(try_cast(value AS INTEGER)) AS n FROM props WHERE slot = 'count' GROUP BY 1, 2)
SELECT r.trace_id, r.a1 AS holder, e.concept, sum(coalesce(c.n, 1))::BIGINT AS n FROM rel r JOIN trace_entities e ON e.trace_id = r.trace_id AND e.eid = r.a0 LEFT JOIN c ON c.trace_id = r.trace_id AND c.eid = r.a0 WHERE r.relation = 'havi' GROUP BY 1, 2, 3""")
def owned_count(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    n = s.props.where("slot = 'count'").groupBy("trace_id", "eid").agg(F.min(F.col("value").try_cast("int")).alias("n"))
    own = s.relations.where("relation = 'havi'").select("trace_id", F.col("a0").alias("eid"), F.col("a1").alias("holder"))
    j = own.join(s.entities.select("trace_id", "eid", "concept"), ["trace_id", "eid"]).join(n, ["trace_id", "eid"], "left")
    return j.groupBy("trace_id", "holder", "concept").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))


@query(f"""WITH {EV}, {ROLES}, {PROPS} SELECT p.slot, p.value, r.role = 'agent' AS agents, string_agg(DISTINCT e.action, ' ' ORDER BY e.action) AS verbs FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id JOIN props p ON p.trace_id = e.trace_id AND p.eid = r.value GROUP BY 1, 2, 3""")
def reverse_maps(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    j = s.events.select("trace_id", "event_id", "action").join(s.roles, ["trace_id", "event_id"]).withColumnRenamed("value", "eid").join(s.props, ["trace_id", "eid"])
    pairs = j.select("slot", "value", (F.col("role") == "agent").alias("agents"), "action").distinct()  # verbs are a small vocabulary
    return pairs.groupBy("slot", "value", "agents").agg(F.array_join(F.array_sort(F.collect_set("action")), " ").alias("verbs"))


@query(f"""WITH {EV}, {ROLES}, c AS (SELECT DISTINCT trace_id, unnest(caused_by) AS event_id FROM ev), s AS (SELECT e.action AS kind, e.trace_id, e.event_id, c.event_id IS NOT NULL AS done FROM ev e LEFT JOIN c USING (trace_id, event_id) WHERE len(e.caused_by) = 0 OR e.caused_by IS NULL)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE done) AS n_done, round(count(*) FILTER (WHERE done) / count(*), 6) AS share FROM s GROUP BY 1""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    caused = s.causes.select("trace_id", "event_id").distinct().withColumn("caused", F.lit(True))
    done = s.causes.select("trace_id", F.col("cause").alias("event_id")).distinct().withColumn("done", F.lit(1))
    seeds = s.events.join(caused, ["trace_id", "event_id"], "left").where("caused is null").join(done, ["trace_id", "event_id"], "left")
    n_done = F.coalesce(F.sum("done"), F.lit(0))
    return seeds.groupBy(F.col("action").alias("kind")).agg(F.count("*").alias("n"), n_done.alias("n_done"), F.round(n_done / F.count("*"), 6).alias("share"))


@query(f"""WITH {EV}, {ROLES}, {REL}, g AS (SELECT DISTINCT trace_id, least(a0, a1) AS a, greatest(a0, a1) AS b FROM rel WHERE a0 <> a1), s AS (SELECT DISTINCT x.trace_id, least(x.value, y.value) AS a, greatest(x.value, y.value) AS b FROM roles x JOIN roles y ON y.trace_id = x.trace_id AND y.event_id = x.event_id AND x.role = 'agent' AND y.role = 'theme' WHERE x.value <> y.value),
u AS (SELECT trace_id, a, b, max(g) AS g, max(s) AS s FROM (SELECT *, 1 AS g, 0 AS s FROM g UNION ALL SELECT *, 0, 1 FROM s) GROUP BY 1, 2, 3) SELECT trace_id, sum(g)::BIGINT AS n_gold, sum(s)::BIGINT AS n_said, sum(g * s)::BIGINT AS n_both FROM u GROUP BY 1""")
def entity_pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    pair = lambda df, a, b: df.where(F.col(a) != F.col(b)).select("trace_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    role = lambda name: s.roles.where(F.col("role") == name).select("trace_id", "event_id", F.col("value").alias(name))
    gold = pair(s.relations, "a0", "a1").select("*", F.lit(1).alias("g"), F.lit(0).alias("s"))
    said = pair(role("agent").join(role("theme"), ["trace_id", "event_id"]), "agent", "theme").select("*", F.lit(0).alias("g"), F.lit(1).alias("s"))
    u = gold.unionByName(said).groupBy("trace_id", "a", "b").agg(F.max("g").alias("g"), F.max("s").alias("s"))
    return u.groupBy("trace_id").agg(F.sum("g").alias("n_gold"), F.sum("s").alias("n_said"), F.sum(F.col("g") * F.col("s")).alias("n_both"))


@query(f"""WITH {PROPS}, c AS (SELECT DISTINCT e.concept, p.slot, p.value FROM trace_entities e JOIN props p ON p.trace_id = e.trace_id AND p.eid = e.eid WHERE p.slot = 'temperature')
SELECT e.trace_id, e.eid AS x, c.value AS y FROM trace_entities e JOIN c USING (concept) WHERE e.entity_type = 'artifact'""")
def concept_field_read(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    c = s.entities.join(s.props.where("slot = 'temperature'"), ["trace_id", "eid"]).select("concept", F.col("value").alias("y")).distinct()
    return s.entities.where("etype = 'artifact'").join(c, "concept").select("trace_id", F.col("eid").alias("x"), "y")


@query(f"""WITH {PROPS}, n AS (SELECT e.trace_id, e.concept, p.value AS adjective, count(DISTINCT e.eid) AS n FROM trace_entities e JOIN props p ON p.trace_id = e.trace_id AND p.eid = e.eid WHERE p.slot = 'temperature' GROUP BY 1, 2, 3)
SELECT trace_id, concept, n, adjective || CASE WHEN n > 1 THEN 'j' ELSE '' END || ' ' || concept || CASE WHEN n > 1 THEN 'j' ELSE '' END AS phrase FROM n""")
def adjective_agreement(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    n = s.entities.join(s.props.where("slot = 'temperature'"), ["trace_id", "eid"]).groupBy("trace_id", "concept", "value").agg(F.countDistinct("eid").alias("n"))
    many = F.col("n") > 1
    return n.select("trace_id", "concept", "n", F.concat_ws(" ", agree(F.col("value"), many), agree(F.col("concept"), many)).alias("phrase"))


@query(f"""WITH {PROPS}, t AS (SELECT DISTINCT 'slot' AS what, p.slot || '=' || p.value AS name, 0 AS arg, e.entity_type AS type FROM props p JOIN trace_entities e ON e.trace_id = p.trace_id AND e.eid = p.eid WHERE e.entity_type IS NOT NULL), {REL},
r AS (SELECT DISTINCT 'relation', relation, 0, e.entity_type FROM rel JOIN trace_entities e ON e.trace_id = rel.trace_id AND e.eid = rel.a0 WHERE e.entity_type IS NOT NULL UNION SELECT DISTINCT 'relation', relation, 1, e.entity_type FROM rel JOIN trace_entities e ON e.trace_id = rel.trace_id AND e.eid = rel.a1 WHERE e.entity_type IS NOT NULL)
SELECT * FROM t UNION ALL SELECT * FROM r""")
def writability_maps(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    e = s.entities.where("etype is not null").select("trace_id", "eid", F.col("etype").alias("type"))
    slots = s.props.join(e, ["trace_id", "eid"]).select(F.lit("slot").alias("what"), F.concat_ws("=", "slot", "value").alias("name"), F.lit(0).alias("arg"), "type")
    args = [s.relations.join(e.withColumnRenamed("eid", f"a{i}"), ["trace_id", f"a{i}"]).select(F.lit("relation").alias("what"), F.col("relation").alias("name"), F.lit(i).alias("arg"), "type") for i in (0, 1)]
    return slots.unionByName(args[0]).unionByName(args[1]).distinct()


@query(f"""WITH {PROPS}, v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT value FROM props WHERE slot = 'temperature'))
SELECT e.trace_id, e.eid, v.value FROM trace_entities e JOIN v ON v.k = floor({U.format("(e.trace_id || '|' || e.eid)", 'vary')} * v.n)""")
def instance_randomisation(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    words = [r[0] for r in s.props.where("slot = 'temperature'").select("value").distinct().orderBy("value").limit(1001).collect()]
    if len(words) > 1000:  # a slot's vocabulary is part of the catalog
        raise ValueError("vocabulary of more than 1000 values")
    u = F.round(sampling.uniform(F.concat_ws("|", "trace_id", "eid"), "vary"), 9)
    return s.entities.select("trace_id", "eid", F.get(F.array(*[F.lit(w) for w in words]), F.floor(u * len(words)).cast("int")).alias("value")).where("value is not null")


# ---------------------------------------------------------------- traces: messages


@query(f"""WITH {EV}, {ROLES}, {REL}, m AS (SELECT e.trace_id, r.value AS a0, max_by(e.action, (e.pos, e.event_id)) AS action FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id AND r.role = 'theme' GROUP BY 1, 2)
SELECT rel.trace_id, rel.relation, rel.a0, rel.a1, coalesce(m.action, 'setup') AS by FROM rel LEFT JOIN m USING (trace_id, a0)""")
def relation_attribution(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    theme = s.roles.where("role = 'theme'").select("trace_id", "event_id", F.col("value").alias("a0"))
    last = s.events.join(theme, ["trace_id", "event_id"]).groupBy("trace_id", "a0").agg(F.max_by("action", F.struct("pos", "event_id")).alias("action"))
    return s.relations.join(last, ["trace_id", "a0"], "left").select("trace_id", "relation", "a0", "a1", F.coalesce("action", F.lit("setup")).alias("by"))


@query(f"""WITH {EV}, {ROLES}, {REL} SELECT DISTINCT r.trace_id, r.value AS eid, 'La ' || regexp_replace(r.value, '[0-9]+$', '') || ' estas ĉi tie.' AS text FROM roles r WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.trace_id = r.trace_id AND rel.a0 = r.value AND rel.relation IN ('en', 'sur'))""")
def synthetic_grounding(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    told = s.roles.select("trace_id", F.col("value").alias("eid")).distinct()
    placed = s.relations.where("relation in ('en', 'sur')").select("trace_id", F.col("a0").alias("eid")).distinct()
    noun = F.regexp_replace("eid", "[0-9]+$", "")
    return told.join(placed, ["trace_id", "eid"], "left_anti").select("trace_id", "eid", F.concat(F.lit("La "), noun, F.lit(" estas ĉi tie.")).alias("text"))


@query(f"""WITH {EV}, o AS (SELECT trace_id, pos, event_id, action, caused_by, lead(event_id) OVER w AS nxt, lead(action) OVER w AS next_action, lead(caused_by) OVER w AS causes FROM ev WINDOW w AS (PARTITION BY trace_id ORDER BY pos, event_id))
SELECT trace_id, event_id, nxt, action || ', tiel ke ' || next_action AS text FROM o WHERE list_contains(causes, event_id)""")
def subordinate_creations(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    w = W.partitionBy("trace_id").orderBy("pos", "event_id")
    o = s.events.select("trace_id", "event_id", "action", F.lead("event_id").over(w).alias("nxt"), F.lead("action").over(w).alias("then"))
    by = s.causes.select("trace_id", F.col("event_id").alias("nxt"), F.col("cause").alias("event_id")).distinct()
    return o.join(by, ["trace_id", "nxt", "event_id"]).select("trace_id", "event_id", "nxt", F.concat("action", F.lit(", tiel ke "), "then").alias("text"))


# ---------------------------------------------------------------- rules over catalogs


@query(f"""WITH {REL} SELECT DISTINCT x.trace_id, 'sur through en' AS action, 'x=' || x.a0 || ',y=' || x.a1 || ',z=' || y.a1 AS binding, 'sur|' || x.a0 || '|' || x.a1 || ' en|' || y.a0 || '|' || y.a1 AS pre, 'en|' || x.a0 || '|' || y.a1 AS eff
FROM rel x JOIN rel y ON y.trace_id = x.trace_id AND y.a0 = x.a1 WHERE x.relation = 'sur' AND y.relation = 'en'""")
def derivation_grounding(spark: SparkSession, d: str) -> DataFrame:
    g = planner.ground_derivations(state(spark, d), registry.per_locative(("sur",), "en"))
    return g.select("trace_id", "action", "binding", F.array_join("pre", " ").alias("pre"), F.array_join("add", " ").alias("eff"))


@query(f"""SELECT trace_id, 'en|' || regexp_extract(binding, 'theme=([^,]+)', 1) || '|' || regexp_extract(binding, 'place=([^,]+)', 1) AS fact, action, count(*) AS n FROM ({ORACLE['ground_actions']}) GROUP BY 1, 2, 3""")
def consumer_index(spark: SparkSession, d: str) -> DataFrame:
    """Actions that a fact is a precondition of, by the grounded actions of each trace."""
    g = planner.ground(state(spark, d), [TAKE])
    return g.select("trace_id", F.explode("pre").alias("fact"), "action").groupBy("trace_id", "fact", "action").agg(F.count("*").alias("n"))


def catalog_state(spark: SparkSession, d: str) -> TraceState:
    """The concepts as one scene of their own: rules over it bake properties into the catalog."""
    s = state(spark, d)
    e = s.entities.groupBy("concept").agg(F.min("etype").alias("etype"))
    entities = e.select(F.lit(0).cast("long").alias("trace_id"), F.col("concept").alias("eid"), "concept", "etype", F.lit(None).cast("int").alias("created_at"), F.lit(None).cast("int").alias("destroyed_at"))
    props = s.entities.join(s.props, ["trace_id", "eid"]).groupBy("concept", "slot").agg(F.min("value").alias("value")).select(F.lit(0).cast("long").alias("trace_id"), F.col("concept").alias("eid"), "slot", "value")
    none = lambda df: df.limit(0)
    return s.with_(entities=entities, props=props, relations=spark.createDataFrame([], REL_SCHEMA), events=none(s.events), roles=none(s.roles), causes=none(s.causes))


BAKE = [
    Derivation("hot", Entity(X, slots={"temperature": "varmega"}), (Property(X, "danger", "jes"),)),
    Derivation("fenced", Entity(X, slots={"danger": "jes"}), (Property(X, "fence", "jes"),)),
]


@query(f"""WITH {PROPS}, c AS (SELECT e.concept, p.slot, min(p.value) AS value FROM trace_entities e JOIN props p ON p.trace_id = e.trace_id AND p.eid = e.eid GROUP BY 1, 2)
SELECT concept, unnest(['danger', 'fence']) AS slot, 'jes' AS value FROM c WHERE slot = 'temperature' AND value = 'varmega'""")
def concept_bake(spark: SparkSession, d: str) -> DataFrame:
    return derive(catalog_state(spark, d), BAKE).d_props.select(F.col("eid").alias("concept"), "slot", "value")


FACTS = [
    {"relation": "en", "container": {"entity": {"type": "location"}}, "contained": {"entity": {"type": "artifact"}}},
    {"relation": "sur", "container": {"entity": {"type": "artifact", "has_suffix": "lo"}}, "contained": {"entity": {"temperature": "varmega"}}},
    {"relation": "apud", "container": {"entity": {"type": "location"}}, "contained": {"entity": {"concept": "kato"}}, "contains": "martelo"},
]
_CONCEPTS = f"""cc AS (SELECT concept, min(entity_type) AS etype FROM trace_entities GROUP BY 1), ch AS (SELECT DISTINCT e.concept FROM trace_entities e JOIN props p ON p.trace_id = e.trace_id AND p.eid = e.eid WHERE p.slot = 'temperature' AND p.value = 'varmega'),
f1 AS (SELECT a.concept AS container, b.concept AS contained, 'en' AS relation, 0 AS ord FROM cc a JOIN cc b ON a.etype = 'location' AND b.etype = 'artifact' UNION ALL SELECT a.concept, b.concept, 'sur', 1 FROM cc a JOIN ch b ON a.etype = 'artifact' AND a.concept LIKE '%lo')"""


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    v = s.entities.join(s.props, ["trace_id", "eid"]).groupBy("concept", "slot").agg(F.array_sort(F.collect_set("value")).alias("vs"))  # a slot has a small vocabulary
    m = v.groupBy("concept").agg(F.map_from_entries(F.collect_list(F.struct("slot", "vs"))).alias("props"))
    return s.entities.groupBy("concept").agg(F.min("etype").alias("etype")).join(m, "concept", "left")


@query(f"""WITH RECURSIVE {PROPS}, {_CONCEPTS}, w AS (SELECT container, contained FROM f1 UNION SELECT w.container, f1.contained FROM w JOIN f1 ON f1.container = w.contained)
SELECT * FROM f1 UNION ALL SELECT a.concept, b.concept, 'apud', 2 FROM cc a JOIN cc b ON a.etype = 'location' AND b.concept = 'kato' WHERE EXISTS (SELECT 1 FROM w WHERE w.container = a.concept AND w.contained = 'martelo' AND w.container <> w.contained)""")
def containment_patterns(spark: SparkSession, d: str) -> DataFrame:
    return containment_facts(_concepts(spark, d), FACTS, CATALOG).drop("required")


@query(f"""WITH RECURSIVE {PROPS}, {_CONCEPTS}, w AS (SELECT min(concept) AS concept FROM cc WHERE etype = 'location' UNION SELECT f1.contained FROM w JOIN f1 ON f1.container = w.concept) SELECT concept FROM w""")
def containment_reach(spark: SparkSession, d: str) -> DataFrame:
    c = _concepts(spark, d)
    scene = c.where("etype = 'location'").agg(F.min("concept")).first()[0]
    return reachable_concepts(containment_facts(c, FACTS[:2], CATALOG), scene)


SCHEMAS = {
    "en": RelationSchema((None, "location"), excludes={0: ("person",)}),
    "sur": RelationSchema((None, "physical"), patterns={0: {"not": {"entity": {"temperature": "varmega"}}}}),
    "havi": RelationSchema(("physical", "person"), not_part=(0,)),
    "portas": RelationSchema(("person", None), compare=((0, "count", ">=", 1, "count"),)),
}
_SUB = {t: _in(CATALOG.subtypes(t)) for t in ("location", "person", "physical")}


@query(f"""WITH {PROPS}, t AS (SELECT DISTINCT trace_id, relation, args FROM trace_relations), parts AS (SELECT DISTINCT trace_id, args[1] AS eid FROM t WHERE relation = 'en'),
j AS (SELECT t.*, a.eid AS e0, b.eid AS e1, a.entity_type AS t0, b.entity_type AS t1, EXISTS (SELECT 1 FROM parts p WHERE p.trace_id = t.trace_id AND p.eid = args[1]) AS part, EXISTS (SELECT 1 FROM props p WHERE p.trace_id = t.trace_id AND p.eid = args[1] AND p.slot = 'temperature' AND p.value = 'varmega') AS hot
 FROM t LEFT JOIN trace_entities a ON a.trace_id = t.trace_id AND a.eid = args[1] LEFT JOIN trace_entities b ON b.trace_id = t.trace_id AND b.eid = args[2])
SELECT trace_id, relation, array_to_string(args, ' ') AS args, CASE WHEN relation NOT IN ('en', 'sur', 'havi', 'portas') THEN 'unknown relation' WHEN len(args) <> 2 THEN 'arity' WHEN e0 IS NULL OR e1 IS NULL THEN 'kind'
 WHEN relation = 'en' AND NOT coalesce(t1 IN ({_SUB['location']}), false) OR relation = 'sur' AND NOT coalesce(t1 IN ({_SUB['physical']}), false) OR relation = 'havi' AND NOT (coalesce(t0 IN ({_SUB['physical']}), false) AND coalesce(t1 IN ({_SUB['person']}), false)) OR relation = 'portas' AND NOT coalesce(t0 IN ({_SUB['person']}), false) THEN 'type'
 WHEN relation = 'en' AND coalesce(t0 IN ({_SUB['person']}), false) THEN 'excluded' WHEN relation = 'havi' AND part THEN 'part' WHEN relation = 'sur' AND hot THEN 'pattern' END AS reason FROM j""")
def relation_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "trace_entities").select("trace_id", "eid", "concept", F.col("entity_type").alias("etype"), F.col("properties").alias("props"))
    r = table(spark, d, "trace_relations").select("trace_id", "relation", "args")
    parts = r.where("relation = 'en'").select("trace_id", F.get("args", F.lit(0)).alias("eid"))
    out = checked_relations(r, e, SCHEMAS, CATALOG, parts=parts)
    return out.select("trace_id", "relation", F.array_join("args", " ").alias("args"), "reason")


# ---------------------------------------------------------------- words


@query("""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-ZĉĝĥĵŝŭĈĜĤĴŜŬ]+'))) AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT w, length(w) > 3 AND w LIKE '%n' AS acc FROM w), a AS (SELECT w, acc, CASE WHEN acc THEN left(w, length(w) - 1) ELSE w END AS v FROM n),
p AS (SELECT w, acc, v, length(v) > 3 AND v LIKE '%j' AS plural FROM a), q AS (SELECT w, acc, plural, CASE WHEN plural THEN left(v, length(v) - 1) ELSE v END AS v FROM p),
e AS (SELECT *, CASE WHEN length(v) >= 4 AND right(v, 2) IN ('as', 'is', 'os', 'us') THEN right(v, 2) WHEN length(v) >= 3 AND right(v, 1) IN ('o', 'a', 'e', 'i', 'u') THEN right(v, 1) ELSE '' END AS ending FROM q)
SELECT w AS word, left(v, length(v) - length(ending)) AS stem, trim(ending || CASE WHEN plural THEN ' j' ELSE '' END || CASE WHEN acc THEN ' n' ELSE '' END) AS endings FROM e""")
def word_endings(spark: SparkSession, d: str) -> DataFrame:
    """Stem and endings of every distinct word, the marks of number and case apart."""
    words = table(spark, d, "documents").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-ZĉĝĥĵŝŭĈĜĤĴŜŬ]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    acc = (F.length("word") > 3) & F.endswith(F.col("word"), F.lit("n"))
    v = words.withColumn("acc", acc).withColumn("v", F.when(acc, F.expr("left(word, length(word) - 1)")).otherwise(F.col("word")))
    many = (F.length("v") > 3) & F.endswith(F.col("v"), F.lit("j"))
    v = v.withColumn("many", many).withColumn("v", F.when(many, F.expr("left(v, length(v) - 1)")).otherwise(F.col("v")))
    end = F.when((F.length("v") >= 4) & F.expr("right(v, 2)").isin("as", "is", "os", "us"), F.expr("right(v, 2)")).when((F.length("v") >= 3) & F.expr("right(v, 1)").isin("o", "a", "e", "i", "u"), F.expr("right(v, 1)")).otherwise("")
    v = v.withColumn("end", end)
    tail = F.concat("end", F.when(F.col("many"), " j").otherwise(""), F.when(F.col("acc"), " n").otherwise(""))
    return v.select("word", F.expr("left(v, length(v) - length(end))").alias("stem"), F.trim(tail).alias("endings"))


@query(f"""WITH RECURSIVE {REL}, e AS (SELECT trace_id, a0 AS s, a1 AS t FROM rel WHERE a0 <> a1 UNION SELECT trace_id, a1, a0 FROM rel WHERE a0 <> a1), g AS (SELECT trace_id, min(eid) AS a, max(eid) AS b FROM trace_entities GROUP BY 1),
p AS (SELECT trace_id, a AS x, 0 AS k FROM g UNION SELECT p.trace_id, e.t, p.k + 1 FROM p JOIN e ON e.trace_id = p.trace_id AND e.s = p.x WHERE p.k < 12), m AS (SELECT trace_id, x, min(k) AS k FROM p GROUP BY 1, 2)
SELECT g.trace_id, 'at|' || g.b AS goal, m.k IS NOT NULL AS found, coalesce(m.k, 0)::INTEGER AS n_steps FROM g LEFT JOIN m ON m.trace_id = g.trace_id AND m.x = g.b""")
def plan_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest plans: the lengths that the search finds, without the plans themselves."""
    return QUERIES["plan_search"](spark, d).select("trace_id", "goal", "found", "n_steps")


# ---------------------------------------------------------------- scenes

_PLACED = f"""{PROPS}, {_CONCEPTS}, {REL}, un AS (SELECT trace_id, eid, concept FROM trace_entities e WHERE entity_type IS DISTINCT FROM 'location' AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.trace_id = e.trace_id AND r.a0 = e.eid AND r.relation IN ('en', 'sur'))),
pl AS (SELECT u.trace_id, u.eid, min((f.ord, b.eid, f.relation)) AS m FROM un u JOIN f1 f ON f.contained = u.concept JOIN trace_entities b ON b.trace_id = u.trace_id AND b.concept = f.container WHERE b.eid <> u.eid GROUP BY 1, 2)"""


@query(f"WITH {_PLACED} SELECT trace_id, eid, m[3] AS relation, m[2] AS container FROM pl")
def placement(spark: SparkSession, d: str) -> DataFrame:
    return scenes.placements(state(spark, d), containment_facts(_concepts(spark, d), FACTS[:2], CATALOG))


@query(f"""WITH {_PLACED}, w AS (SELECT contained AS concept, min((ord, container)) AS m FROM f1 GROUP BY 1), n AS (SELECT u.trace_id, w.m[2] AS want, count(*) AS n FROM un u JOIN w USING (concept) WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.trace_id = u.trace_id AND pl.eid = u.eid) GROUP BY 1, 2)
SELECT trace_id, want AS concept, want || '_nova' AS eid FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, want) AS rn FROM n) WHERE rn <= 6""")
def spawner(spark: SparkSession, d: str) -> DataFrame:
    return scenes.spawned(state(spark, d), containment_facts(_concepts(spark, d), FACTS[:2], CATALOG))


@query(f"""WITH {EV}, {ROLES}, n AS (SELECT e.action, r.role, coalesce(t.entity_type, '?') AS type, count(*) AS n FROM ev e JOIN roles r ON r.trace_id = e.trace_id AND r.event_id = e.event_id JOIN trace_entities t ON t.trace_id = e.trace_id AND t.eid = r.value GROUP BY 1, 2, 3)
SELECT action, role, max_by(type, (n, type)) AS type, max(n) AS n FROM n GROUP BY 1, 2""")
def recipe_generation(spark: SparkSession, d: str) -> DataFrame:
    return scenes.recipes(state(spark, d))


@query(f"""WITH {EV}, {ROLES}, {REL}, deg AS (SELECT trace_id, x AS a0, count(*) AS degree FROM (SELECT trace_id, unnest([a0, a1]) AS x FROM rel) GROUP BY 1, 2), th AS (SELECT DISTINCT trace_id, value AS a0 FROM roles WHERE role = 'theme'),
m AS (SELECT r.trace_id, r.trace_id || '|' || relation || '|' || r.a0 || '|' || r.a1 AS move, 2.0 * coalesce((e.entity_type = 'person')::INTEGER, 0) + 0.5 * d.degree + CASE WHEN th.a0 IS NOT NULL THEN 1.0 ELSE 0.0 END AS score FROM rel r JOIN deg d ON d.trace_id = r.trace_id AND d.a0 = r.a0 JOIN trace_entities e ON e.trace_id = r.trace_id AND e.eid = r.a0 LEFT JOIN th ON th.trace_id = r.trace_id AND th.a0 = r.a0)
SELECT trace_id, max_by(move, (round(score / 0.7 - ln(-ln((('0x' || left(md5(move || 'move'), 8))::BIGINT + 0.5) / 4294967296.0)), 9), move)) AS move FROM m GROUP BY 1""")
def forward_moves(spark: SparkSession, d: str) -> DataFrame:
    return scenes.moves(state(spark, d), {"person": 2.0, "degree": 0.5, "told": 1.0}, 0.7, "move")

