"""A lexicon folder (JSON lines with stated schemas) as DataFrames and a small catalog.

Files: ``types.json`` (child to parent), ``slots.jsonl``, ``concepts.jsonl``,
``relations.jsonl``, ``actions.jsonl``, ``affixes.jsonl``, ``containment.jsonl``.  Files
that are absent give empty frames.  Problems are rows of ``violations``, not exceptions;
``load(..., strict=True)`` raises when there are any.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators.state import Catalog

SLOTS = "name string, vocabulary array<string>, applies_to array<string>, scalar boolean, varies boolean, pervasive boolean, weights array<double>"
CONCEPTS = "lemma string, entity_type string, category array<string>, properties map<string, array<string>>, parts array<struct<concept:string,relation:string>>"
RELATIONS = "name string, arity int, arg_types array<string>, arg_names array<string>, inverse string, symmetric boolean"
ACTIONS = "lemma string, transitivity string, roles array<struct<name:string,type:string>>, effects array<struct<target_role:string,property:string,value:string>>"
AFFIXES = "form string, kind string, attaches_to string, produces string, output_type string"
CONTAINMENT = "container string, contained string, relation string, required boolean"
#: Most rows of a dimension that is also kept on the driver.
MAX_DIMENSION = 200_000


@dataclass(frozen=True)
class Lexicon:
    catalog: Catalog
    slots: DataFrame
    concepts: DataFrame
    relations: DataFrame
    actions: DataFrame
    affixes: DataFrame
    containment: DataFrame
    props: DataFrame  # (owner, slot, value) with inherited values
    violations: DataFrame  # (what, name, reason)


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}")


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_DIMENSION + 1).collect()
    if len(rows) > MAX_DIMENSION:
        raise ValueError(f"{what} has more than {MAX_DIMENSION} rows")
    return rows


def load(spark: SparkSession, folder: str, strict: bool = False) -> Lexicon:
    text = spark.read.text(f"{folder}/types.json", wholetext=True).first()
    types: dict[str, str | None] = json.loads(text[0]) if text else {}
    slots, concepts = _read(spark, folder, "slots.jsonl", SLOTS), _read(spark, folder, "concepts.jsonl", CONCEPTS)
    relations, actions = _read(spark, folder, "relations.jsonl", RELATIONS), _read(spark, folder, "actions.jsonl", ACTIONS)
    affixes, containment = _read(spark, folder, "affixes.jsonl", AFFIXES), _read(spark, folder, "containment.jsonl", CONTAINMENT)
    own = concepts.select(F.col("lemma").alias("owner"), F.explode("properties").alias("slot", "vs")).select("owner", "slot", F.explode("vs").alias("value"))
    parents = concepts.select(F.col("lemma").alias("src"), F.explode("category").alias("dst"))
    props = C.inherited(own, parents).select("owner", "slot", "value")
    flags = slots.select(F.col("name").alias("slot"), "vocabulary", F.coalesce("scalar", F.lit(True)).alias("scalar"))
    names = spark.createDataFrame([(t,) for t in types] or [("",)], "name string")
    bad = C.value_violations(own, flags).select(F.lit("property").alias("what"), F.concat_ws(".", "owner", "slot").alias("name"), "reason")
    bad = bad.unionByName(concepts.join(names.select(F.col("name").alias("entity_type")), "entity_type", "left_anti").select(F.lit("concept").alias("what"), F.col("lemma").alias("name"), F.lit("unknown type").alias("reason")))
    bad = bad.unionByName(relations.where(F.size("arg_types") != F.col("arity")).select(F.lit("relation").alias("what"), "name", F.lit("arity").alias("reason")))
    role = actions.select("lemma", F.transform("roles", lambda r: r["name"]).alias("have"), F.explode("effects").alias("e"))
    bad = bad.unionByName(role.where(~F.array_contains("have", F.col("e.target_role"))).select(F.lit("action").alias("what"), F.col("lemma").alias("name"), F.lit("effect on unknown role").alias("reason")))
    bad = bad.unionByName(spark.createDataFrame([("type", c, "unknown parent") for c, p in types.items() if p and p not in types] or [("", "", "")], "what string, name string, reason string").where("what <> ''"))
    cat = Catalog(
        types=types,
        categories={r.lemma: tuple(r.category or ()) for r in _bounded(concepts.select("lemma", "category"), "concepts")},
        symmetric=frozenset(r.name for r in _bounded(relations.where("symmetric"), "relations")),
        multi_valued=frozenset(r.name for r in _bounded(slots.where("scalar = false"), "slots")),
    )
    if strict and (rows := bad.limit(20).collect()):
        raise ValueError(f"lexicon problems: {[tuple(r) for r in rows]}")
    return Lexicon(cat, slots, concepts, relations, actions, affixes, containment, props, bad)


def composed(concepts: DataFrame, affixes: DataFrame) -> DataFrame:
    """(lemma, base, affix, entity_type): lemmas made by attaching affixes to stems.

    A prefix stands before the lemma; a suffix replaces the ending.  Affixes are a small
    fixed dimension; concepts join them on the type they attach to."""
    j = concepts.join(affixes, F.col("entity_type") == F.col("attaches_to"))
    stem = F.regexp_replace("lemma", "[oaei]$", "")
    made = F.when(F.col("kind") == "prefix", F.concat("form", "lemma")).otherwise(F.concat(stem, "form", F.coalesce("produces", F.lit("o"))))
    return j.select(made.alias("lemma"), F.col("lemma").alias("base"), F.col("form").alias("affix"), F.coalesce("output_type", "entity_type").alias("entity_type"))
