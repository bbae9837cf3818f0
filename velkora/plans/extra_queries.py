"""Further reports, windows and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as T
from ..functions import text as X
from ..operators import events as ev
from ..operators import similarity
from ..sources import sinks
from ..streaming import live
from .fact_queries import CL, RANKED, TV, U, USABLE, ok, templates
from .queries import query, table
from .trace_queries import EV, LIVE, ROLES, state


@query(f"""WITH {EV}, {ROLES}, a AS (SELECT trace_id, value AS item, max(pos) AS pos FROM ev JOIN roles USING (trace_id, event_id) WHERE role = 'theme' AND action IN ('preni','aĉeti','trovi','porti') GROUP BY 1, 2),
u AS (SELECT trace_id, value AS item, max(pos) AS used FROM ev JOIN roles USING (trace_id, event_id) WHERE role = 'theme' AND action IN ('sendi','vendi','kaŝi') GROUP BY 1, 2), l AS (SELECT trace_id, max(pos) AS fin FROM ev GROUP BY 1)
SELECT trace_id, item, pos, fin - pos AS age FROM a LEFT JOIN u USING (trace_id, item) JOIN l USING (trace_id) WHERE (used IS NULL OR used < pos) AND fin - pos <= 5""")
def reservoir_decay(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    e = s.events.join(s.roles.where("role = 'theme'"), ["trace_id", "event_id"]).select("trace_id", F.col("value").alias("item"), "pos", "action")
    return ev.reservoir(e.where(F.col("action").isin("preni", "aĉeti", "trovi", "porti")), e.where(F.col("action").isin("sendi", "vendi", "kaŝi")), s.events, 5)


@query("""WITH RECURSIVE m AS (SELECT doc_id, regexp_replace(text, '[^()\\[\\]{}]', '', 'g') AS s FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, s, 0 AS i, 0 AS deep, 0 AS lft FROM m
UNION ALL SELECT doc_id, s, i + 1, greatest(deep, lft + CASE WHEN substr(s, i + 1, 1) IN ('(','[','{') THEN 1 ELSE 0 END), greatest(lft + CASE WHEN substr(s, i + 1, 1) IN ('(','[','{') THEN 1 WHEN substr(s, i + 1, 1) IN (')',']','}') THEN -1 ELSE 0 END, 0) FROM f WHERE i < length(s))
SELECT doc_id, deep AS deepest, lft AS open FROM f WHERE i = length(s)""")
def paren_depth(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", X.nesting(F.col("text")).alias("x")).select("doc_id", "x.deepest", F.col("x.left").alias("open"))


@query(f"""WITH {CL}, {USABLE}, {RANKED} SELECT entity_id, arg_min(property_id, (CASE WHEN property_id IN ('P8','P14') THEN 0 ELSE 1 END, seq)) AS property_id, arg_min(value, (CASE WHEN property_id IN ('P8','P14') THEN 0 ELSE 1 END, seq)) AS value FROM rk GROUP BY 1""")
def opening_fact(spark: SparkSession, d: str) -> DataFrame:
    return T.opening_fact(ok(spark, d), ["P8", "P14"])


@query(f"""WITH {CL}, {USABLE}, s AS (SELECT entity_id, e.label, e.class_id, map_from_entries(list_sort(list(DISTINCT (property, value)))) AS m FROM (SELECT entity_id, property, value FROM ok) JOIN fact_entities e USING (entity_id) GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY {U.format('entity_id', 'tell')}, entity_id) - 1 AS k FROM s),
p AS (SELECT x.class_id, x.label AS a, y.label AS b, x.m AS ma, y.m AS mb, list_sort(list_intersect(map_keys(x.m), map_keys(y.m))) AS sh FROM o x JOIN o y ON x.class_id = y.class_id AND x.k % 2 = 0 AND y.k = x.k + 1)
SELECT class_id, a, b, array_to_string(list_transform(sh, lambda k: CASE WHEN ma[k] = mb[k] THEN 'Ambaŭ: ' || k || ' – ' || ma[k] || '.' ELSE k || ': ' || ma[k] || ' kaj ' || mb[k] || '.' END), ' ') AS text FROM p WHERE len(sh) >= 2""")
def comparison_paragraph(spark: SparkSession, d: str) -> DataFrame:
    f = ok(spark, d).join(table(spark, d, "fact_entities").select("entity_id", "class_id"), "entity_id")
    return T.comparison(f, ["class_id"], "tell")


@query(f"""WITH {CL}, {USABLE}, {RANKED}, {TV}, t AS (SELECT entity_id, e.class_id, replace(replace(question, '{{subj}}', rk.label), '{{obj}}', value) || ' ' || replace(replace(answer, '{{subj}}', rk.label), '{{obj}}', value) AS l, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS rn FROM rk JOIN tp USING (property_id) JOIN fact_entities e USING (entity_id)),
o AS (SELECT class_id, entity_id, string_agg(l, chr(10) ORDER BY rn) AS chat, count(*) AS n FROM t WHERE rn <= 2 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY {U.format('entity_id', 'cross')}, entity_id) - 1 AS k FROM o)
SELECT x.class_id, x.entity_id AS a, y.entity_id AS b, CAST(x.n + y.n AS INTEGER) AS n, x.chat || chr(10) || y.chat AS chat FROM k x JOIN k y ON x.class_id = y.class_id AND x.k % 2 = 0 AND y.k = x.k + 1""")
def cross_entity_qa(spark: SparkSession, d: str) -> DataFrame:
    q = T.question_answers(T.ranked(ok(spark, d)), templates(spark))
    q = q.join(table(spark, d, "fact_entities").select("entity_id", "class_id"), "entity_id")
    return T.cross_entity(q, "class_id", "cross")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS a, e.vec_id AS b, q.label AS la, e.label AS lb, list_cosine_similarity(q.v, e.v) AS cos FROM q JOIN e ON q.vec_id <> e.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cos, 9) DESC, b) AS rn FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rn) AS k FROM t WHERE rn <= 100 AND la = lb)
SELECT a, b, round(cos, 6) AS cos FROM f WHERE k <= 5""")
def topk_by_type(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "embeddings")
    top = similarity.cosine_topk(e, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 100)
    la, lb = e.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"))
    w = W.partitionBy("a").orderBy(F.desc("cos"), "b")
    return top.join(la, "a").join(lb, "b").where("la = lb").withColumn("k", F.row_number().over(w)).where("k <= 5").select("a", "b", "cos")


@query(f"""WITH {LIVE}, p AS (SELECT trace_id, count(*) FILTER (WHERE entity_type = 'person') AS persons, count(*) FILTER (WHERE entity_type = 'artifact') AS things FROM live GROUP BY 1)
SELECT CASE WHEN persons = 0 THEN 'no_sample' WHEN things = 0 THEN 'failed' ELSE 'fired' END AS outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM p GROUP BY 1""")
def yield_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = state(spark, d).entities.where("destroyed_at is null")
    p = e.groupBy("trace_id").agg(F.count_if(F.col("etype") == "person").alias("persons"), F.count_if(F.col("etype") == "artifact").alias("things"))
    g = p.groupBy(F.when(F.col("persons") == 0, "no_sample").when(F.col("things") == 0, "failed").otherwise("fired").alias("outcome")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))  # one row
    return g.join(total, F.lit(True)).select("outcome", "n", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 4).alias("percent"))


@query("SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "2 days"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS score FROM factual_qa")
def result_store(spark: SparkSession, d: str) -> DataFrame:
    """Scores written twice; the second writing replaces those of even ids."""
    q = table(spark, d, "factual_qa").select("item_id")
    path = f"{live.shared_folder(spark)}/scores"
    sinks.merge_small(q.withColumn("score", F.lit(1)), path, "item_id")
    sinks.merge_small(q.where("item_id % 2 = 0").withColumn("score", F.lit(2)), path, "item_id")
    return spark.read.parquet(path)


@query("""WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    s = live.read_stream(spark, f"{d}/events.parquet")
    return live.finished(live.windows(s, "ts", "2 days", ["event_type"], slide="1 day", late="60 days"), "complete")


FORBIDDEN = [("en", 1, "person"), ("havi", 0, "location"), ("portas", 0, "artifact")]


@query("""WITH rel AS (SELECT DISTINCT trace_id, relation, args[1] AS a0, args[2] AS a1 FROM trace_relations), f(relation, pos, etype) AS (VALUES ('en',1,'person'),('havi',0,'location'),('portas',0,'artifact'))
SELECT trace_id, relation, a0, a1 FROM rel r WHERE NOT EXISTS (SELECT 1 FROM f JOIN trace_entities e ON e.entity_type = f.etype WHERE f.relation = r.relation AND e.trace_id = r.trace_id AND e.eid = CASE WHEN f.pos = 0 THEN r.a0 ELSE r.a1 END)""")
def forbidden_effects(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import predicates

    s = state(spark, d)
    f = spark.createDataFrame(FORBIDDEN, "relation string, pos int, etype string")
    return predicates.allowed_effects(s.relations, s.entities, f)


@query("""WITH rel AS (SELECT DISTINCT trace_id, relation, args[1] AS a0, args[2] AS a1 FROM trace_relations), up(type, ancestor) AS (VALUES ('physical','physical'),('inanimate','inanimate'),('artifact','artifact'),('person','person'),('location','location'),('inanimate','physical'),('artifact','inanimate'),('artifact','physical'),('person','physical')),
ro(relation, t0, t1) AS (VALUES ('en','physical','location'),('havi','person','inanimate'),('portas','person','physical')), g AS (SELECT DISTINCT r.relation, p.entity_type AS a0type, q.entity_type AS a1type FROM rel r JOIN trace_entities p ON p.trace_id = r.trace_id AND p.eid = r.a0 JOIN trace_entities q ON q.trace_id = r.trace_id AND q.eid = r.a1 WHERE p.entity_type IS NOT NULL AND q.entity_type IS NOT NULL)
SELECT DISTINCT g.relation, a0type, a1type FROM g JOIN up x ON x.type = a0type JOIN up y ON y.type = a1type JOIN ro ON ro.relation = g.relation AND ro.t0 = x.ancestor AND ro.t1 = y.ancestor""")
def producer_reachability(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import predicates
    from ..operators.closure import closure
    from .trace_queries import TYPES

    s = state(spark, d)
    t = s.entities.where("etype is not null").select("trace_id", "eid", "etype")
    g = s.relations.join(t.select("trace_id", F.col("eid").alias("a0"), F.col("etype").alias("a0type")), ["trace_id", "a0"]).join(t.select("trace_id", F.col("eid").alias("a1"), F.col("etype").alias("a1type")), ["trace_id", "a1"])
    up = closure(spark.createDataFrame([(c, p) for c, p in TYPES.items() if p], "src string, dst string")).select(F.col("src").alias("type"), F.col("dst").alias("ancestor"))
    up = up.unionByName(spark.createDataFrame([(c, c) for c in TYPES], "type string, ancestor string"))
    roles = spark.createDataFrame([("en", "physical", "location"), ("havi", "person", "inanimate"), ("portas", "person", "physical")], "relation string, t0 string, t1 string")
    return predicates.reachable_goals(g.select("relation", "a0type", "a1type").distinct(), roles, up)


@query()
def unknown_word_rate(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import morphology

    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(X.letter_words(F.col("text"))).alias("word"))
    return morphology.unknown_rates(w, "doc_id")


@query("""WITH p AS (SELECT e.trace_id, e.event_id, e.action, c.cause FROM (SELECT DISTINCT trace_id, event_id, action, unnest(caused_by) AS cause FROM trace_events) c JOIN (SELECT DISTINCT trace_id, event_id, action FROM trace_events) e USING (trace_id, event_id)),
n AS (SELECT f.action AS producer, p.action AS consumer, count(*) AS n FROM p JOIN (SELECT DISTINCT trace_id, event_id, action FROM trace_events) f ON f.trace_id = p.trace_id AND f.event_id = p.cause GROUP BY 1, 2) SELECT producer, consumer, n, CAST(rank() OVER (PARTITION BY producer ORDER BY n DESC) AS INTEGER) AS place FROM n""")
def action_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    s = state(spark, d)
    e = s.events.select("trace_id", "event_id", "action").distinct()
    c = s.causes.distinct().join(e.withColumnRenamed("action", "consumer"), ["trace_id", "event_id"])
    n = c.join(e.select("trace_id", F.col("event_id").alias("cause"), F.col("action").alias("producer")), ["trace_id", "cause"]).groupBy("producer", "consumer").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(W.partitionBy("producer").orderBy(F.desc("n"))))


def _u(key: str, draw: str, n: str) -> str:
    return f"CAST(floor(((('0x' || left(md5(CAST({key} AS VARCHAR) || '{draw}'), 8))::BIGINT + 0.5) / 4294967296.0) * {n}) AS INTEGER) + 1"


@query(f"""WITH eff(slot, value, verbs) AS (VALUES ('integrity','rompita',['fali','rompi']),('temperature','malvarma',['lavi']),('koloro','ruĝa',['pentri'])),
g AS (SELECT trace_id AS goal_id, ['integrity','temperature'][(trace_id % 2 + 1)::INTEGER] AS slot, ['rompita','malvarma'][(trace_id % 2 + 1)::INTEGER] AS value FROM (SELECT DISTINCT trace_id FROM trace_entities)),
pl AS (SELECT entity_type AS kind, list(DISTINCT concept ORDER BY concept) AS cs FROM trace_entities WHERE entity_type IN ('person','artifact','location') GROUP BY 1), a AS (SELECT cs FROM pl WHERE kind = 'person'), t AS (SELECT cs FROM pl WHERE kind = 'artifact'), l AS (SELECT cs FROM pl WHERE kind = 'location')
SELECT goal_id, slot, value, verbs[{_u('goal_id', 'verb', 'len(verbs)')}] AS verb, a.cs[{_u('goal_id', 'agent', 'len(a.cs)')}] AS agent, t.cs[{_u('goal_id', 'theme', 'len(t.cs)')}] AS theme, l.cs[{_u('goal_id', 'place', 'len(l.cs)')}] AS place FROM g JOIN eff USING (slot, value), a, t, l""")
def goal_regression(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import catalog, sampling
    from .more_queries import effects

    e = table(spark, d, "trace_entities")
    # concepts are a catalog: each pool is a short fixed list
    pools = e.where("entity_type in ('person', 'artifact', 'location')").groupBy(F.col("entity_type").alias("kind")).agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    even = F.col("trace_id") % 2 == 0
    goals = e.select("trace_id").distinct().select(F.col("trace_id").alias("goal_id"), F.when(even, "integrity").otherwise("temperature").alias("slot"), F.when(even, "rompita").otherwise("malvarma").alias("value"))
    return sampling.regressed_scenes(goals, catalog.producers(effects(spark)), pools)


_NAME = "'la ' || regexp_replace({0}, '[0-9]+$', '')"
_ACC = "CASE WHEN regexp_matches(regexp_replace({0}, '[0-9]+$', ''), '(o|a|oj|aj)$') AND regexp_replace({0}, '[0-9]+$', '') <> 'la' THEN 'n' ELSE '' END"


@query(f"""WITH {EV}, s AS (SELECT trace_id, event_id, pos, action, caused_by, coalesce(roles['agent'], 'io') AS agent, roles['theme'] AS theme FROM ev),
c AS (SELECT DISTINCT trace_id, event_id, unnest(caused_by) AS cause FROM s), w AS (SELECT c.trace_id, c.event_id, arg_min({_NAME.format('x.agent')} || ' ' || regexp_replace(x.action, 'i$', 'is'), (x.pos, c.cause)) AS said FROM c JOIN s x ON x.trace_id = c.trace_id AND x.event_id = c.cause GROUP BY 1, 2), p AS (SELECT DISTINCT trace_id, pos FROM ev)
SELECT s.trace_id, s.pos, 'event' AS kind, s.event_id AS subject, 'La ' || regexp_replace(agent, '[0-9]+$', '') || ' ' || regexp_replace(action, 'i$', 'is') || CASE WHEN theme IS NOT NULL THEN ' ' || {_NAME.format('theme')} || {_ACC.format('theme')} ELSE '' END || coalesce(', ĉar ' || said, '') || '.' AS text FROM s LEFT JOIN w USING (trace_id, event_id)
UNION ALL SELECT e.trace_id, e.created_at, 'appears', e.eid, 'La ' || regexp_replace(e.eid, '[0-9]+$', '') || ' aperis.' FROM trace_entities e JOIN p ON p.trace_id = e.trace_id AND p.pos = e.created_at
UNION ALL SELECT e.trace_id, e.destroyed_at, 'vanishes', e.eid, 'La ' || regexp_replace(e.eid, '[0-9]+$', '') || ' malaperis.' FROM trace_entities e JOIN p ON p.trace_id = e.trace_id AND p.pos = e.destroyed_at""")
def realize_messages(spark: SparkSession, d: str) -> DataFrame:
    from . import realize

    return realize.messages(state(spark, d))
