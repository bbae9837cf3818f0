"""Catalog, relational and conversation queries beyond traces and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chat
from ..operators import catalog
from ..operators import sampling, sequences
from .queries import query, table
from .trace_queries import PROPS

OWN = "own AS (SELECT DISTINCT concept AS owner, u.key AS slot, unnest(u.value) AS value FROM (SELECT concept, unnest(map_entries(properties)) AS u FROM trace_entities))"


def own(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "trace_entities")
    return e.select(F.col("concept").alias("owner"), F.explode("properties").alias("slot", "vs")).select("owner", "slot", F.explode("vs").alias("value")).distinct()


@query(f"""WITH {OWN}, s(slot, vocabulary, scalar) AS (VALUES ('temperature', ['varma','malvarma'], false), ('integrity', NULL, true)), n AS (SELECT owner, slot, count(DISTINCT value) AS n FROM own GROUP BY 1, 2)
SELECT DISTINCT owner, slot, value, CASE WHEN scalar IS NULL THEN 'unknown slot' WHEN vocabulary IS NOT NULL AND NOT list_contains(vocabulary, value) THEN 'not in vocabulary' WHEN scalar AND n > 1 THEN 'more than one value' END AS reason
FROM own LEFT JOIN s USING (slot) JOIN n USING (owner, slot) WHERE scalar IS NULL OR (vocabulary IS NOT NULL AND NOT list_contains(vocabulary, value)) OR (scalar AND n > 1)""")
def catalog_violations(spark: SparkSession, d: str) -> DataFrame:
    slots = spark.createDataFrame([("temperature", ["varma", "malvarma"], False), ("integrity", None, True)], "slot string, vocabulary array<string>, scalar boolean")
    return catalog.value_violations(own(spark, d), slots)


CLASSES = "par AS (SELECT i.item_id AS src, 'E' || CAST(CAST(substr(i.item_id, 2) AS INTEGER) // 3 AS VARCHAR) AS dst FROM fact_items i WHERE CAST(substr(i.item_id, 2) AS INTEGER) >= 3)"


@query(f"""WITH RECURSIVE {CLASSES}, o AS (SELECT item_id AS owner, 'kind' AS slot, kind AS value FROM fact_items WHERE CAST(substr(item_id, 2) AS INTEGER) < 9),
up AS (SELECT src AS owner, dst AS anc, 1 AS depth FROM par UNION SELECT u.owner, p.dst, u.depth + 1 FROM up u JOIN par p ON p.src = u.anc),
a AS (SELECT u.owner, slot, value, depth, anc FROM up u JOIN o ON o.owner = u.anc UNION ALL SELECT owner, slot, value, 0, owner FROM o)
SELECT owner, slot, arg_min(value, (depth, anc, value)) AS value, arg_min(depth, (depth, anc, value)) AS depth FROM a GROUP BY 1, 2""")
def inherit_first_wins(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "fact_items").withColumn("k", F.substring("item_id", 2, 9).cast("int"))
    parents = i.where("k >= 3").select(F.col("item_id").alias("src"), F.concat(F.lit("E"), F.floor(F.col("k") / 3).cast("string")).alias("dst"))
    o = i.where("k < 9").select(F.col("item_id").alias("owner"), F.lit("kind").alias("slot"), F.col("kind").alias("value"))
    return catalog.inherited(o, parents)


@query("WITH par AS (SELECT item_id AS src, 'E' || (CAST(substr(item_id, 2) AS INTEGER) * 3) AS dst FROM fact_items) SELECT src, dst FROM par WHERE dst NOT IN (SELECT item_id FROM fact_items)")
def missing_parents(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "fact_items").withColumn("k", F.substring("item_id", 2, 9).cast("int"))
    parents = i.select(F.col("item_id").alias("src"), F.concat(F.lit("E"), (F.col("k") * 3).cast("string")).alias("dst"))
    return catalog.missing_parents(parents, i.select(F.col("item_id").alias("name")))


@query(f"WITH {OWN} SELECT slot, value, count(DISTINCT owner) AS n, string_agg(DISTINCT owner, ' ' ORDER BY owner) AS owners FROM own GROUP BY 1, 2")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return catalog.postings(own(spark, d)).select("slot", "value", "n", F.array_join("owners", " ").alias("owners"))


@query(f"WITH {OWN} SELECT DISTINCT owner FROM own WHERE owner IN (SELECT owner FROM own WHERE slot = 'temperature' AND value IN ('varma','varmega')) AND owner IN (SELECT owner FROM own WHERE slot = 'integrity' AND value = 'tuta')")
def index_selection(spark: SparkSession, d: str) -> DataFrame:
    return catalog.all_of(own(spark, d), {"temperature": ("varma", "varmega"), "integrity": "tuta"})


@query(f"""WITH {OWN}, o AS (SELECT DISTINCT concept AS owner FROM trace_entities), a AS (SELECT DISTINCT owner, slot, 0 AS how FROM own UNION ALL SELECT owner, 'temperature', 1 FROM o UNION ALL SELECT owner, 'mass', 2 FROM o)
SELECT owner, slot, ['declared','pervasive','derivable'][min(how) + 1] AS how FROM a GROUP BY 1, 2""")
def concept_models_slot(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "trace_entities").select(F.col("concept").alias("owner"))
    return catalog.models_slot(own(spark, d), types, ["temperature"], ["mass"])


EFFECTS = [("fali", "integrity", "rompita"), ("rompi", "integrity", "rompita"), ("lavi", "temperature", "malvarma"), ("pentri", "koloro", "ruĝa")]
EV_SQL = "eff(verb, slot, value) AS (VALUES ('fali','integrity','rompita'),('rompi','integrity','rompita'),('lavi','temperature','malvarma'),('pentri','koloro','ruĝa'))"


def effects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EFFECTS, "verb string, slot string, value string")


@query(f"WITH {EV_SQL} SELECT slot, value, string_agg(DISTINCT verb, ' ' ORDER BY verb) AS verbs FROM eff GROUP BY 1, 2")
def goal_index(spark: SparkSession, d: str) -> DataFrame:
    return catalog.producers(effects(spark)).select("slot", "value", F.array_join("verbs", " ").alias("verbs"))


@query(f"""WITH {OWN}, {EV_SQL}, b AS (SELECT DISTINCT verb, owner FROM eff, (SELECT DISTINCT concept AS owner FROM trace_entities))
SELECT verb, owner FROM b WHERE NOT EXISTS (SELECT 1 FROM eff e WHERE e.verb = b.verb AND NOT EXISTS (SELECT 1 FROM own o WHERE o.owner = b.owner AND o.slot = e.slot))""")
def effect_meaningful(spark: SparkSession, d: str) -> DataFrame:
    e = effects(spark)
    owners = table(spark, d, "trace_entities").select(F.col("concept").alias("owner")).distinct()
    verbs = [v for v in dict.fromkeys(x[0] for x in EFFECTS)]
    b = owners.select("owner", F.explode(F.array(*[F.lit(v) for v in verbs])).alias("verb"))
    return catalog.meaningful(e, b, own(spark, d).select("owner", "slot").distinct()).select("verb", "owner")


@query("SELECT p_partkey, round(p_size * 0.01 * p_size * 0.02 * 0.5 * p_retailprice / 1000 * 1000, 6) AS mass FROM part")
def numeric_bake(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    m = catalog.mass(F.col("p_size") * 0.01, F.col("p_size") * 0.02, F.lit(0.5), F.col("p_retailprice") / 1000)
    return p.select("p_partkey", F.round(m, 6).alias("mass"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(printf('%.6f', round(p_retailprice * pow(10, 3 - floor(log10(abs(p_retailprice)))), 0) / pow(10, 3 - floor(log10(abs(p_retailprice))))), '0+$', ''), '\\.$', '') AS price FROM part""")
def compact_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", catalog.compact_number(F.col("p_retailprice")).alias("price"))


@query()
def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "common_words").select(F.split("word", "").alias("symbols"), F.col("per_million").cast("long").alias("n"))
    return spark.createDataFrame([(i, a, b, n) for i, (a, b, n) in enumerate(catalog.bpe_merges(w, 8))], "rank int, a string, b string, n long")


# ---------------------------------------------------------------- conversation functions


@query("""WITH h AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?[.!?])\\s', 1) AS head FROM documents WHERE text IS NOT NULL), t AS (SELECT *, trim(substr(text, length(head) + 1), ' ') AS tail FROM h)
SELECT doc_id, head, tail FROM t WHERE length(head) > 0 AND length(head) <= 0.7 * length(text) AND length(tail) >= 20""")
def continuation_split(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", chat.continuation_split(F.col("text")).alias("s")).where("s is not null")
    return t.select("doc_id", "s.head", "s.tail")


_FOLD = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT item_id, coalesce(list_bool_or(list_transform(answer, lambda a: contains(' ' || {_FOLD.format('question')} || ' ', ' ' || {_FOLD.format('a')} || ' '))), false) AS hit FROM factual_qa")
def answer_in_question(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "factual_qa").select("item_id", F.coalesce(chat.answered(F.col("question"), F.col("answer")), F.lit(False)).alias("hit"))


@query("SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN '„Saluton“, diris ' || label || '.' WHEN 1 THEN '– Saluton – diris ' || label || '.' ELSE '“Saluton” diris ' || label || '.' END AS line FROM embeddings")
def quote_styles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", chat.quote_styles(F.lit("Saluton"), F.col("label").cast("string"), F.col("vec_id") % 3).alias("line"))


_R = "CAST(floor(((('0x' || left(md5(CAST(event_id AS VARCHAR) || '{0}'), 8))::BIGINT + 0.5) / 4294967296.0) * {1}) + {2} AS INTEGER)"


@query(f"""WITH d AS (SELECT event_id, {_R.format('kind', 4, 0)} AS k, {_R.format('a', 89, 11)} AS x, {_R.format('b', 98, 2)} AS y FROM events), e AS (SELECT *, CASE k WHEN 1 THEN x + y WHEN 3 THEN x * y ELSE x END AS a FROM d)
SELECT event_id, ['add','sub','mul','div'][k + 1] AS kind, a, y AS b, 'Kiom estas ' || a || ' ' || ['+','-','*','/'][k + 1] || ' ' || y || '?' AS question, CAST(CASE k WHEN 0 THEN a + y WHEN 1 THEN a - y WHEN 2 THEN a * y ELSE x END AS INTEGER) AS answer FROM e""")
def arithmetic_cot(spark: SparkSession, d: str) -> DataFrame:
    a = chat.arithmetic(table(spark, d, "events").select("event_id"), "event_id")
    return a.select("event_id", "kind", "a", "b", "question", "answer")


@query()
def gzip_diversity(spark: SparkSession, d: str) -> DataFrame:
    return chat.gzip_ratio(table(spark, d, "documents").where("text is not null"), "site", "text")


# ---------------------------------------------------------------- relational


@query("""SELECT n_name, o_year, CAST(sum(rev) AS DOUBLE) AS revenue FROM (SELECT n.n_name, year(o.o_orderdate) AS o_year, CAST(l.l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS rev FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE l.l_returnflag = 'R') GROUP BY 1, 2""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).alias("rev"))  # noqa: E741
    # lines shrink to one row an order before they meet anything else
    per = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("rev").alias("rev"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("long").alias("o_year"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return per.join(o, "o_orderkey").join(c, "c_custkey").join(n, "n_nationkey").groupBy("n_name", "o_year").agg(F.sum("rev").cast("double").alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)""")
def pricing_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn <= 2""")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    j = o.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")
    w = W.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return j.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_type, count(*) AS n, approx AS top FROM (SELECT event_type, max(value) AS approx FROM events GROUP BY 1) JOIN events USING (event_type) GROUP BY 1, 3")
def event_maxima(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(f"WITH {PROPS}, p AS (SELECT DISTINCT trace_id, eid FROM props WHERE slot = 'temperature'), q AS (SELECT DISTINCT trace_id, eid FROM props WHERE slot = 'integrity') SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM p INTERSECT SELECT * FROM q) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM q EXCEPT SELECT * FROM p)")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "trace_entities").select("trace_id", "eid", F.explode(F.map_keys("properties")).alias("slot"))
    p, q = (e.where(F.col("slot") == s).select("trace_id", "eid").distinct() for s in ("temperature", "integrity"))
    count = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count(p.intersect(q), "both").unionByName(count(p.subtract(q), "first")).unionByName(count(q.subtract(p), "second"))


@query("SELECT source, min(rn) AS first_kept, count(*) AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY round((('0x' || left(md5(CAST(doc_id AS VARCHAR) || 'taxon'), 8))::BIGINT + 0.5) / 4294967296.0, 9), doc_id) AS rn, (('0x' || left(md5(CAST(doc_id AS VARCHAR) || 'taxon'), 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM documents) WHERE u < CASE WHEN source = 'wiki' THEN 0.3 ELSE 1.0 END GROUP BY 1")
def taxon_downsampling(spark: SparkSession, d: str) -> DataFrame:
    u = sampling.uniform(F.col("doc_id"), "taxon")
    t = table(spark, d, "documents").select("source", "doc_id", u.alias("u"))
    t = sequences.numbered(t, ["source"], F.round("u", 9), "doc_id", "at").withColumn("rn", F.col("at") + 1)
    return t.where(F.col("u") < F.when(F.col("source") == "wiki", 0.3).otherwise(1.0)).groupBy("source").agg(F.min("rn").alias("first_kept"), F.count("*").alias("n"))
