"""Predicate, precondition and preference queries over the trace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import predicates as P
from ..sources import lexicon
from .queries import query, table
from .trace_queries import CATALOG, PROPS, REL, state

PATTERN = {"and": [{"entity": {"type": "physical"}}, {"or": [{"entity": {"temperature": ["varma", "varmega"]}}, {"not": {"entity": {"has_suffix": "o"}}}]}]}


@query(f"""WITH {PROPS} SELECT trace_id, eid FROM trace_entities e WHERE entity_type IN ('physical','inanimate','artifact','person') AND (EXISTS (SELECT 1 FROM props p WHERE p.trace_id = e.trace_id AND p.eid = e.eid AND p.slot = 'temperature' AND p.value IN ('varma','varmega')) OR NOT concept LIKE '%o')""")
def json_predicate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "trace_entities").select("trace_id", "eid", "concept", F.col("entity_type").alias("etype"), F.col("properties").alias("props"))
    return e.where(P.json_predicate(PATTERN, CATALOG)).select("trace_id", "eid")


def bindings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = state(spark, d)
    r = s.relations.where("relation in ('en', 'sur') and a0 <> a1").select("trace_id", F.col("a0").alias("thing"), F.col("a1").alias("place")).distinct()
    return r.withColumn("bid", F.concat_ws("|", F.col("trace_id").cast("string"), "thing", "place")), s.props, s.relations


B = "b AS (SELECT DISTINCT trace_id, a0 AS thing, a1 AS place FROM rel WHERE relation IN ('en','sur') AND a0 <> a1)"
HAS = "EXISTS (SELECT 1 FROM props p WHERE p.trace_id = b.trace_id AND p.eid = b.{0} AND p.slot = '{1}' AND p.value = '{2}')"


@query(f"""WITH {PROPS}, {REL}, {B} SELECT trace_id, thing, place FROM b WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.trace_id = b.trace_id AND r.relation = 'havi' AND r.a0 = b.thing AND r.a1 = b.place)
AND (NOT {HAS.format('thing', 'temperature', 'varmega')} OR {HAS.format('thing', 'integrity', 'tuta')}) AND ({HAS.format('thing', 'temperature', 'varma')} OR {HAS.format('place', 'integrity', 'tuta')})
AND EXISTS (SELECT 1 FROM props p JOIN props q ON q.trace_id = p.trace_id AND q.value = p.value WHERE p.trace_id = b.trace_id AND p.eid = b.thing AND p.slot = 'integrity' AND q.eid = b.place AND q.slot = 'integrity')""")
def precondition_eval(spark: SparkSession, d: str) -> DataFrame:
    b, props, rel = bindings(spark, d)
    specs = [
        ("not_relation", {"name": "havi", "a0": "thing", "a1": "place"}),
        ("if_property", {"role": "thing", "slot": "temperature", "value": "varmega", "then": {"role": "thing", "slot": "integrity", "value": "tuta"}}),
        ("or", {"any": [("has_property", {"role": "thing", "slot": "temperature", "value": "varma"}), ("has_property", {"role": "place", "slot": "integrity", "value": "tuta"})]}),
        ("match", {"a": "thing", "b": "place", "slot": "integrity"}),
    ]
    return P.permitted(b, specs, props, rel).select("trace_id", "thing", "place")


@query(f"WITH {PROPS}, w(slot, wanted) AS (VALUES ('temperature','varma'),('integrity','tuta')) SELECT trace_id, eid, slot, value, CASE WHEN trace_id % 2 = 0 AND slot = 'temperature' THEN 'malvarma' ELSE wanted END AS wanted FROM props JOIN w USING (slot) WHERE value <> CASE WHEN trace_id % 2 = 0 AND slot = 'temperature' THEN 'malvarma' ELSE wanted END")
def displeased_slots(spark: SparkSession, d: str) -> DataFrame:
    prefs = spark.createDataFrame([("temperature", "varma"), ("integrity", "tuta")], "slot string, wanted string")
    p = state(spark, d).props
    day = P.displeased(p.where("trace_id % 2 <> 0"), prefs)
    night = P.displeased(p.where("trace_id % 2 = 0"), P.context_preferences(prefs, {"temperature": "malvarma"}, F.lit(True)))
    return day.unionByName(night)


@query("""SELECT DISTINCT e.concept AS owner FROM trace_entities e WHERE e.entity_type IN ('artifact','inanimate') AND EXISTS (SELECT 1 FROM trace_entities f WHERE f.concept = e.concept AND list_contains(f.properties['integrity'], 'tuta'))""")
def role_semantic_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "trace_entities").select(F.col("concept").alias("owner"), F.col("entity_type").alias("etype"), "properties")
    props = e.select("owner", F.explode("properties").alias("slot", "vs")).select("owner", "slot", F.explode("vs").alias("value"))
    flags = spark.createDataFrame([("temperature", True), ("integrity", False)], "slot string, loose boolean")
    return P.role_matches(e.select("owner", "etype"), props, flags, ["artifact", "inanimate"], {"temperature": "varma", "integrity": "tuta"})


@query("SELECT trace_id, eid, 'pluvi' AS action FROM trace_entities WHERE entity_type = 'location'")
def weather_emission(spark: SparkSession, d: str) -> DataFrame:
    return P.emitted_by_world(state(spark, d).entities, "pluva", {"pluva": "pluvi", "venta": "blovi"}, "location", "klara")


@query(f"""WITH {PROPS}, a AS (SELECT DISTINCT trace_id, eid AS subject, 'temperature' AS slot, 'malvarma' AS value FROM props WHERE slot = 'temperature' AND value = 'varmega'), x AS (SELECT DISTINCT trace_id, eid AS subject, slot, value FROM props)
SELECT * FROM a UNION SELECT * FROM x WHERE NOT (slot = 'integrity' AND value = 'rompita') AND NOT EXISTS (SELECT 1 FROM a WHERE a.trace_id = x.trace_id AND a.subject = x.subject AND a.slot = x.slot)""")
def fact_delta(spark: SparkSession, d: str) -> DataFrame:
    f = state(spark, d).props.withColumnRenamed("eid", "subject").distinct()
    adds = f.where("slot = 'temperature' and value = 'varmega'").withColumn("value", F.lit("malvarma"))
    return P.fact_delta(f, adds, f.where("slot = 'integrity' and value = 'rompita'"), ["temperature"])


@query("""WITH a(form, kind, attaches_to, produces, output_type) AS (VALUES ('mal','prefix','location',NULL,NULL),('ej','suffix','person','o','location')), c AS (SELECT DISTINCT concept AS lemma, entity_type FROM trace_entities WHERE entity_type IS NOT NULL)
SELECT CASE WHEN kind = 'prefix' THEN form || lemma ELSE regexp_replace(lemma, '[oaei]$', '') || form || coalesce(produces, 'o') END AS lemma, lemma AS base, form AS affix, coalesce(output_type, entity_type) AS entity_type FROM c JOIN a ON attaches_to = entity_type""")
def affix_composition(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "trace_entities").where("entity_type is not null").select(F.col("concept").alias("lemma"), "entity_type").distinct()
    a = spark.createDataFrame([("mal", "prefix", "location", None, None), ("ej", "suffix", "person", "o", "location")], lexicon.AFFIXES)
    return lexicon.composed(c, a)
