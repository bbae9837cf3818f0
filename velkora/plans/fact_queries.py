"""Queries over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as T
from ..operators import sampling
from .queries import query, table

CL = "cl AS (SELECT DISTINCT entity_id, pos, property, property_id, value, value_id, datatype FROM fact_claims)"
ALLOWED = ["P1", "P2", "P3", "P4", "P5", "P6", "P7", "P8", "P10", "P11", "P14", "P15"]
IN = ", ".join(f"'{p}'" for p in ALLOWED)
ENGLISH = " OR ".join(f"contains(lower(value), '{m}')" for m in (" the ", " of ", " and ", " in ", "university", "city", "list of"))
BROKEN = "(length(value) < 2 OR length(value) > 80 OR (length(value) >= 2 AND right(value, 1) = substr(value, length(value) - 1, 1) AND regexp_matches(right(value, 1), '\\p{L}')))"
USABLE = f"""us AS (SELECT c.*, e.label, row_number() OVER (PARTITION BY c.entity_id, c.property_id ORDER BY pos, value) AS rn FROM cl c JOIN fact_entities e USING (entity_id)
 WHERE property IS NOT NULL AND value IS NOT NULL AND value <> '' AND property_id IN ({IN}) AND NOT ({ENGLISH}) AND NOT {BROKEN} AND value <> label), ok AS (SELECT * FROM us WHERE rn = 1)"""
RANK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.RANK.items())
RANKED = f"rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE property_id {RANK} ELSE 99 END, pos, value)::INTEGER AS seq FROM ok)"
DATE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\\+', ''), 'T.*$', ''), '-00-[0-9]{{2}}$', ''), '-00$', '')"
AMOUNT = "try_cast(nullif(regexp_extract({0}, '^\\+?(-?[0-9]+(?:\\.[0-9]+)?)(?: |$)', 1), '') AS DOUBLE)"
U = "round((('0x' || left(md5(CAST({0} AS VARCHAR) || '{1}'), 8))::BIGINT + 0.5) / 4294967296.0, 9)"
TEMPLATES = [
    ("P1", "Kio estas {subj}?", "{subj} estas {obj}."),
    ("P2", "En kiu lando troviĝas {subj}?", "{subj} troviĝas en {obj}."),
    ("P3", "Kie situas {subj}?", "{subj} situas en {obj}."),
    ("P8", "Kio estas la okupo de {subj}?", "La okupo de {subj} estas {obj}."),
    ("P14", "Kio estas la ĉefurbo de {subj}?", "La ĉefurbo de {subj} estas {obj}."),
]
TV = "tp(property_id, question, answer) AS (VALUES " + ", ".join(f"('{p}', '{q}', '{a}')" for p, q, a in TEMPLATES) + ")"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims without full duplicates (the load time does not count)."""
    return table(spark, d, "fact_claims").drop("loaded_at").distinct()


def ok(spark: SparkSession, d: str) -> DataFrame:
    return T.usable(claims(spark, d), table(spark, d, "fact_entities"), ALLOWED)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "property_id string, question string, answer string")


@query(f"WITH {CL}, {USABLE} SELECT entity_id, property_id, pos, value FROM ok")
def fact_filter_first(spark: SparkSession, d: str) -> DataFrame:
    return ok(spark, d).select("entity_id", "property_id", "pos", "value")


@query(f"WITH {CL}, {USABLE}, {RANKED} SELECT entity_id, seq, property_id, value FROM rk")
def fact_ordering(spark: SparkSession, d: str) -> DataFrame:
    return T.ranked(ok(spark, d)).select("entity_id", "seq", "property_id", "value")


@query(f"WITH {CL} SELECT entity_id, pos, value, {DATE.format('value')} AS date FROM cl WHERE datatype = 'time' AND value IS NOT NULL")
def partial_date_parse(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("datatype = 'time' and value is not null")
    return c.select("entity_id", "pos", "value", T.partial_date(F.col("value")).alias("date"))


@query(f"WITH {CL} SELECT entity_id, pos, value, {AMOUNT.format('value')} AS amount, CASE WHEN {AMOUNT.format('value')} IS NOT NULL THEN nullif(regexp_extract(value, '^\\S+ (.*)$', 1), '') END AS unit FROM cl WHERE datatype = 'quantity' AND value IS NOT NULL")
def quantity_parse(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("datatype = 'quantity' and value is not null").withColumn("q", T.quantity(F.col("value")))
    return c.select("entity_id", "pos", "value", "q.amount", "q.unit")


KINDS = [("ujo", "place"), ("ejo", "building"), ("ano", "person"), ("io", "region")]
FALL = [("P5", "person"), ("P4", "place")]


@query(f"""WITH {CL}, k AS (SELECT entity_id, pos, CASE WHEN contains(lower(value), 'ujo') THEN 0 WHEN contains(lower(value), 'ejo') THEN 1 WHEN contains(lower(value), 'ano') THEN 2 WHEN contains(lower(value), 'io') THEN 3 END AS k FROM cl WHERE property_id = 'P1' AND value IS NOT NULL),
f AS (SELECT entity_id, arg_min(k, (pos, k)) AS k FROM k WHERE k IS NOT NULL GROUP BY 1), h AS (SELECT entity_id, max((property_id = 'P5')::INT) AS h0, max((property_id = 'P4')::INT) AS h1 FROM cl GROUP BY 1)
SELECT h.entity_id, coalesce(['place','building','person','region'][k + 1], CASE WHEN h0 = 1 THEN 'person' WHEN h1 = 1 THEN 'place' ELSE 'other' END) AS kind FROM h LEFT JOIN f USING (entity_id)""")
def entity_type_detect(spark: SparkSession, d: str) -> DataFrame:
    return T.entity_type(claims(spark, d), KINDS, FALL)


@query("SELECT entity_id FROM fact_entities e WHERE NOT EXISTS (SELECT 1 FROM fact_items i WHERE i.item_id = e.class_id AND (i.kind = 'genro' OR contains(i.label, 'sel')))")
def skip_entity(spark: SparkSession, d: str) -> DataFrame:
    skip = table(spark, d, "fact_items").where((F.col("kind") == "genro") | F.col("label").contains("sel")).select(F.col("item_id").alias("class_id"))
    return table(spark, d, "fact_entities").join(skip, "class_id", "left_anti").select("entity_id")


@query(f"WITH {CL}, {USABLE} SELECT DISTINCT e.label FROM fact_entities e WHERE length(label) > 3 AND NOT regexp_matches(label, '^Q[0-9]+$')")
def topic_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fact_entities").where("length(label) > 3").where(~F.col("label").rlike("^Q[0-9]+$")).select("label").distinct()


@query(f"""WITH {CL}, a AS (SELECT c.entity_id, e.label, c.property_id, {AMOUNT.format('value')} AS amount FROM cl c JOIN fact_entities e USING (entity_id) WHERE datatype = 'quantity'),
v AS (SELECT entity_id, label, property_id, max(amount) AS amount FROM a WHERE amount IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY {U.format('entity_id', 'pair')}, entity_id) - 1 AS rn FROM v),
p AS (SELECT x.property_id, x.label AS a, y.label AS b, x.amount AS va, y.amount AS vb FROM o x JOIN o y ON x.property_id = y.property_id AND x.rn % 2 = 0 AND y.rn = x.rn + 1)
SELECT property_id, a, b, CASE WHEN greatest(abs(va), abs(vb)) = 0 OR abs(va - vb) / greatest(abs(va), abs(vb)) < 0.05 THEN 'equal' WHEN va > vb THEN 'first' ELSE 'second' END AS verdict FROM p""")
def numeric_comparison(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("datatype = 'quantity'").withColumn("amount", T.quantity(F.col("value"))["amount"]).where("amount is not null")
    v = c.join(table(spark, d, "fact_entities").select("entity_id", "label"), "entity_id").groupBy("entity_id", "label", "property_id").agg(F.max("amount").alias("amount"))
    p = T.neighbours(v, ["property_id"], "entity_id", "pair")
    va, vb = F.col("a.amount"), F.col("b.amount")
    return p.select("property_id", F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.when(T.about_equal(va, vb), "equal").when(va > vb, "first").otherwise("second").alias("verdict"))


_PARTS = f"string_split({DATE.format('value')}, '-')"


@query(f"""WITH {CL}, a AS (SELECT entity_id, min(lpad({_PARTS}[1], 4, '0') || '-' || lpad(coalesce({_PARTS}[2], '00'), 2, '0') || '-' || lpad(coalesce({_PARTS}[3], '00'), 2, '0')) AS day FROM cl WHERE property_id = 'P6' AND datatype = 'time' AND value IS NOT NULL AND value <> '' GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY {U.format('entity_id', 'date')}, entity_id) - 1 AS rn FROM (SELECT entity_id, day, substr(day, 1, 2) AS century FROM a)),
q AS (SELECT *, row_number() OVER (PARTITION BY century ORDER BY {U.format('entity_id', 'date')}, entity_id) - 1 AS k FROM o)
SELECT x.century, x.entity_id AS a, y.entity_id AS b, CASE WHEN x.day = y.day THEN 'same' WHEN x.day < y.day THEN 'first' ELSE 'second' END AS earlier FROM q x JOIN q y ON x.century = y.century AND x.k % 2 = 0 AND y.k = x.k + 1""")
def date_comparison(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("property_id = 'P6' and datatype = 'time' and value is not null and value <> ''")
    v = c.groupBy("entity_id").agg(F.min(T.padded_date(F.col("value"))).alias("day")).withColumn("century", F.left("day", F.lit(2)))
    p = T.neighbours(v, ["century"], "entity_id", "date")
    a, b = F.col("a.day"), F.col("b.day")
    return p.select("century", F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"), F.when(a == b, "same").when(a < b, "first").otherwise("second").alias("earlier"))


@query(f"""WITH {CL}, n AS (SELECT c.entity_id, e.label, e.class_id, max({AMOUNT.format('value')}) AS amount FROM cl c JOIN fact_entities e USING (entity_id) WHERE datatype = 'quantity' AND property_id = 'P4' GROUP BY 1, 2, 3)
SELECT class_id, count(*) AS n, max_by(label, (amount, label)) AS most, min_by(label, (amount, label)) AS least FROM n WHERE amount > 0 GROUP BY 1 HAVING count(*) >= 3""")
def superlatives(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("datatype = 'quantity' and property_id = 'P4'").withColumn("amount", T.quantity(F.col("value"))["amount"])
    v = c.join(table(spark, d, "fact_entities").select("entity_id", "label", "class_id"), "entity_id").groupBy("entity_id", "label", "class_id").agg(F.max("amount").alias("amount"))
    return T.superlatives(v, ["class_id"])


@query(f"""WITH {CL}, {USABLE}, p AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY {U.format('entity_id', 'few')}, entity_id) AS k, count(*) OVER (PARTITION BY property_id) AS n FROM ok)
SELECT property_id, string_agg(label || ': ' || value, chr(10) ORDER BY k) AS lines FROM p WHERE n >= 4 AND k <= 6 GROUP BY 1""")
def few_shot_lists(spark: SparkSession, d: str) -> DataFrame:
    f = ok(spark, d).withColumn("u", F.round(sampling.uniform(F.col("entity_id"), "few"), 9))
    many = f.groupBy("property_id").agg(F.count("*").alias("n")).where("n >= 4")
    six = sampling.capped(f, ["property_id"], ["u", "entity_id"], 6).join(many, "property_id")
    g = six.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct("u", "entity_id", F.concat_ws(": ", "label", "value").alias("l")))).alias("x"))
    return g.select("property_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("lines"))


@query(f"WITH {CL}, {USABLE}, a AS (SELECT *, row_number() OVER (PARTITION BY property_id, value ORDER BY entity_id, pos) AS k FROM ok), b AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY entity_id, pos) AS j FROM a WHERE k <= 5) SELECT entity_id, property_id, value FROM b WHERE j <= 200")
def property_cap(spark: SparkSession, d: str) -> DataFrame:
    one = sampling.capped(ok(spark, d), ["property_id", "value"], ["entity_id", "pos"], 5)
    return sampling.capped(one, ["property_id"], ["entity_id", "pos"], 200).select("entity_id", "property_id", "value")


@query(f"WITH {CL}, {USABLE}, {RANKED}, {TV} SELECT entity_id, seq, replace(replace(question, '{{subj}}', label), '{{obj}}', value) AS question, replace(replace(answer, '{{subj}}', label), '{{obj}}', value) AS answer FROM rk JOIN tp USING (property_id)")
def single_turn_qa(spark: SparkSession, d: str) -> DataFrame:
    return T.question_answers(T.ranked(ok(spark, d)), templates(spark))


@query(f"""WITH {CL}, {USABLE}, {RANKED}, {TV}, t AS (SELECT entity_id, seq, replace(replace(question, '{{subj}}', label), '{{obj}}', value) AS q, replace(replace(answer, '{{subj}}', label), '{{obj}}', value) AS a, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS rn FROM rk JOIN tp USING (property_id))
SELECT entity_id, (count(*) * 2)::INTEGER AS n, string_agg('user: ' || q || chr(10) || 'assistant: ' || a, chr(10) ORDER BY rn) AS chat FROM t WHERE rn <= 5 GROUP BY 1 HAVING count(*) >= 2""")
def multi_turn_qa(spark: SparkSession, d: str) -> DataFrame:
    c = T.conversations(T.question_answers(T.ranked(ok(spark, d)), templates(spark)))
    return c.select("entity_id", "n", F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("chat"))


@query(f"""WITH {CL}, {USABLE}, {RANKED}, {TV}, t AS (SELECT entity_id, answer, label, value, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS k FROM rk JOIN tp USING (property_id)),
s AS (SELECT entity_id, k, replace(replace(answer, '{{subj}}', CASE WHEN k = 1 THEN label ELSE 'ĝi' END), '{{obj}}', value) AS s FROM t)
SELECT entity_id, count(*) AS n, string_agg(upper(left(s, 1)) || substr(s, 2), ' ' ORDER BY k) AS text FROM s GROUP BY 1 HAVING count(*) >= 2""")
def fact_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return T.paragraph(ok(spark, d), templates(spark))


@query(f"""WITH {CL}, {USABLE}, s AS (SELECT entity_id, class_id, list_sort(list(DISTINCT property_id || '=' || value)) AS facts, list_sort(list(DISTINCT property_id)) AS props FROM ok JOIN fact_entities USING (entity_id) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY {U.format('entity_id', 'cmp')}, entity_id) - 1 AS k FROM s)
SELECT x.class_id, x.entity_id AS a, y.entity_id AS b, len(list_intersect(x.props, y.props)) AS shared, len(list_intersect(x.facts, y.facts)) AS same FROM o x JOIN o y ON x.class_id = y.class_id AND x.k % 2 = 0 AND y.k = x.k + 1 WHERE len(list_intersect(x.props, y.props)) >= 2""")
def comparable_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = ok(spark, d).join(table(spark, d, "fact_entities").select("entity_id", "class_id"), "entity_id")
    s = f.groupBy("entity_id", "class_id").agg(F.collect_set(F.concat_ws("=", "property_id", "value")).alias("facts"), F.collect_set("property_id").alias("props"))
    p = T.neighbours(s, ["class_id"], "entity_id", "cmp")
    shared = F.size(F.array_intersect("a.props", "b.props")).cast("long")
    return p.select("class_id", F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"), shared.alias("shared"), F.size(F.array_intersect("a.facts", "b.facts")).cast("long").alias("same")).where("shared >= 2")


@query(f"""WITH {CL} SELECT value_id, i.label, i.kind, count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM cl JOIN fact_items i ON i.item_id = cl.value_id GROUP BY 1, 2, 3""")
def value_usage(spark: SparkSession, d: str) -> DataFrame:
    # the fixed item table joins after the aggregation, so the hot value is one row there
    n = claims(spark, d).where("value_id is not null").groupBy("value_id").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"))
    i = table(spark, d, "fact_items").select(F.col("item_id").alias("value_id"), "label", "kind")
    return n.join(i, "value_id").select("value_id", "label", "kind", "n", "n_entities")


@query("SELECT item_id, coalesce(nullif(label, ''), item_id) AS label FROM fact_items")
def label_coalesce(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "fact_items").withColumn("m", F.create_map(F.lit("eo"), F.nullif("label", F.lit(""))))
    return i.select("item_id", F.coalesce(T.labels(F.col("m"), "eo", "en"), "item_id").alias("label"))


@query("SELECT entity_id, property_id, CAST(row_number() OVER (PARTITION BY entity_id, property_id ORDER BY pos, value NULLS FIRST, property, datatype) - 1 AS INTEGER) AS pos, property, value, datatype FROM (SELECT DISTINCT entity_id, pos, property, property_id, value, datatype FROM fact_claims WHERE property IS NOT NULL AND property_id IS NOT NULL)")
def nested_claims(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "fact_claims").where("property is not null and property_id is not null").select("entity_id", "pos", "property", "property_id", "value", "datatype").distinct()
    g = c.groupBy("entity_id", "property_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "property", "datatype"))).alias("x"))
    g = g.withColumn("x", F.transform("x", lambda x: F.struct(F.create_map(F.lit("eo"), x["property"]).alias("label"), x["value"].alias("value"), x["datatype"].alias("datatype"))))
    js = g.groupBy("entity_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("property_id", "x")))).alias("claims"))
    return T.flatten_claims(js, "claims", "entity_id").select("entity_id", "property_id", "pos", "property", "value", "datatype")
