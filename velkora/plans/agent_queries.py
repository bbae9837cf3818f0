"""Planning, generation, realisation, morphology, grammar and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, morphology
from ..functions.text import letter_words
from ..operators import sampling
from ..operators.state import Catalog, load_state
from ..sources import sinks
from ..streaming import live
from . import planner, realize
from .queries import ORACLE, query, table
from .trace_queries import EV, LIVE, REL, ROLES, state

TAKE = planner.Action("preni", {"agent": "person", "theme": "artifact", "place": "location"}, pre=(("en", "theme", "place"),), add=(("havas", "agent", "theme"),), delete=(("en", "theme", "place"),))


@query(f"""WITH {REL}, {LIVE} SELECT r.trace_id, 'preni' AS action, 'agent=' || a.eid || ',place=' || p.eid || ',theme=' || t.eid AS binding, 1 AS cost FROM rel r
JOIN live t ON t.trace_id = r.trace_id AND t.eid = r.a0 AND t.entity_type = 'artifact' JOIN live p ON p.trace_id = r.trace_id AND p.eid = r.a1 AND p.entity_type = 'location'
JOIN live a ON a.trace_id = r.trace_id AND a.entity_type = 'person' WHERE r.relation = 'en'""")
def ground_actions(spark: SparkSession, d: str) -> DataFrame:
    return planner.ground(state(spark, d), [TAKE]).select("trace_id", "action", "binding", "cost")


def _moves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts at(x) and moves along relations, one precondition each."""
    s = state(spark, d)
    edges = s.relations.where("a0 <> a1")
    both = edges.select("trace_id", "a0", "a1").unionByName(edges.select("trace_id", F.col("a1").alias("a0"), F.col("a0").alias("a1"))).distinct()
    acts = both.select("trace_id", F.lit("go").alias("action"), F.concat_ws(">", "a0", "a1").alias("binding"), F.array(F.concat(F.lit("at|"), F.col("a0"))).alias("pre"), F.array(F.concat(F.lit("at|"), F.col("a1"))).alias("add"), F.array(F.concat(F.lit("at|"), F.col("a0"))).alias("del"), F.lit(1).alias("cost"))
    start = s.entities.groupBy("trace_id").agg(F.min("eid").alias("e")).select("trace_id", F.concat(F.lit("at|"), F.col("e")).alias("fact"))
    return start, acts


@query(f"""WITH RECURSIVE {REL}, e AS (SELECT trace_id, a0 AS s, a1 AS t FROM rel WHERE a0 <> a1 UNION SELECT trace_id, a1, a0 FROM rel WHERE a0 <> a1),
p AS (SELECT trace_id, min(eid) AS x, 0 AS k FROM trace_entities GROUP BY 1 UNION SELECT p.trace_id, e.t, p.k + 1 FROM p JOIN e ON e.trace_id = p.trace_id AND e.s = p.x WHERE p.k < 12)
SELECT trace_id, 'at|' || x AS fact, min(k)::BIGINT AS cost FROM p GROUP BY 1, 2""")
def relaxed_cost(spark: SparkSession, d: str) -> DataFrame:
    return planner.relaxed_costs(*_moves(spark, d))


@query()
def plan_search(spark: SparkSession, d: str) -> DataFrame:
    start, acts = _moves(spark, d)
    goals = state(spark, d).entities.groupBy("trace_id").agg(F.max("eid").alias("e")).select("trace_id", F.concat(F.lit("at|"), F.col("e")).alias("goal"))
    return planner.search(start, acts, goals)


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT DISTINCT c.action AS cause, x.action AS act FROM (SELECT trace_id, action, unnest(caused_by) AS by FROM ev) x JOIN ev c ON c.trace_id = x.trace_id AND c.event_id = x.by WHERE c.action <> x.action),
w AS (SELECT act AS goal, cause AS action FROM e UNION SELECT w.goal, e.cause FROM w JOIN e ON e.act = w.action WHERE e.cause <> w.goal) SELECT goal, action FROM w""")
def goal_relevance(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return planner.goal_relevance(s.events, s.causes)


_U = "((('0x' || left(md5(CAST({0} AS VARCHAR) || '{1}'), 8))::BIGINT + 0.5) / 4294967296.0)"


@query(f"""WITH {LIVE}, l AS (SELECT concept, row_number() OVER (ORDER BY concept) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT concept FROM trace_entities WHERE entity_type = 'location')), t AS (SELECT DISTINCT trace_id FROM trace_entities)
SELECT t.trace_id, l.concept AS location, CASE WHEN {_U.format('t.trace_id', 'persons')} < 0.25 THEN 2 ELSE 1 END AS persons, CASE WHEN {_U.format('t.trace_id', 'rooms')} < 2/6.0 THEN 0 WHEN {_U.format('t.trace_id', 'rooms')} < 5/6.0 THEN 1 ELSE 2 END AS rooms
FROM t JOIN l ON l.k = floor({_U.format('t.trace_id', 'place')} * l.n)""")
def scene_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "trace_entities")
    # concepts are a catalog: the list of location concepts is small and fixed
    names = F.array_sort(F.collect_set(F.when(F.col("entity_type") == "location", F.col("concept"))))
    places = e.agg(names.alias("places"))
    u = lambda draw: sampling.uniform(F.col("trace_id"), draw)
    t = e.select("trace_id").distinct().join(F.broadcast(places), F.lit(True))
    return t.select(
        "trace_id",
        F.get("places", F.floor(u("place") * F.size("places")).cast("int")).alias("location"),
        F.when(u("persons") < 0.25, 2).otherwise(1).alias("persons"),
        F.when(u("rooms") < 2 / 6.0, 0).when(u("rooms") < 5 / 6.0, 1).otherwise(2).alias("rooms"),
    )


@query(f"""WITH c AS (SELECT trace_id, eid, coalesce(entity_type, 'none') AS kind FROM trace_entities), k AS (SELECT trace_id, kind FROM (SELECT DISTINCT trace_id, kind FROM c) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY round({_U.format("(trace_id || kind)", 'kind')}, 9), kind) = 1)
SELECT trace_id, kind, eid FROM (SELECT c.*, row_number() OVER (PARTITION BY trace_id ORDER BY round(-ln({_U.format('eid', 'drive')}) / CASE WHEN c.kind = 'person' THEN 20 ELSE 1 END, 9), eid) AS rn FROM c JOIN k USING (trace_id, kind)) WHERE rn = 1""")
def drive_sample(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = table(spark, d, "trace_entities").select("trace_id", "eid", F.coalesce("entity_type", F.lit("none")).alias("kind"))
    w = W.partitionBy("trace_id").orderBy(F.round(sampling.uniform(F.concat(F.col("trace_id").cast("string"), "kind"), "kind"), 9), "kind")
    k = c.select("trace_id", "kind").distinct().withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    chosen = c.join(k, ["trace_id", "kind"])
    weight = F.when(F.col("kind") == "person", 20).otherwise(1)
    order = F.round(-F.log(sampling.uniform(F.col("eid"), "drive")) / weight, 9)
    return chosen.withColumn("rn", F.row_number().over(W.partitionBy("trace_id").orderBy(order, "eid"))).where("rn = 1").select("trace_id", "kind", "eid")


@query(f"""WITH {REL}, g AS (SELECT trace_id, relation, a1, string_agg('la ' || regexp_replace(a0, '[0-9]+$', ''), ' kaj ' ORDER BY 'la ' || regexp_replace(a0, '[0-9]+$', '')) AS who FROM rel WHERE relation IN ('en','sur') GROUP BY 1, 2, 3)
SELECT trace_id, relation || '|' || a1 AS seq, upper(left(who, 1)) || substr(who, 2) || ' estas ' || relation || ' la ' || regexp_replace(a1, '[0-9]+$', '') || '.' AS text FROM g""")
def realize_setting(spark: SparkSession, d: str) -> DataFrame:
    return realize.setting(state(spark, d))


@query(f"""WITH {EV}, s AS (SELECT trace_id, pos, event_id, action, roles['theme'] AS theme, coalesce(roles['agent'], 'io') AS agent FROM ev), f AS (SELECT *, CASE WHEN agent IS DISTINCT FROM lag(agent) OVER (PARTITION BY trace_id ORDER BY pos, event_id) THEN 1 ELSE 0 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
c AS (SELECT *, regexp_replace(action, 'i$', 'is') || CASE WHEN theme IS NOT NULL THEN ' la ' || regexp_replace(theme, '[0-9]+$', '') || CASE WHEN regexp_matches(regexp_replace(theme, '[0-9]+$', ''), '(o|a|oj|aj)$') THEN 'n' ELSE '' END ELSE '' END AS clause FROM i)
SELECT trace_id, CAST(island AS BIGINT) AS island, 'La ' || regexp_replace(agent, '[0-9]+$', '') || ' ' || string_agg(clause, ', poste ' ORDER BY pos, event_id) || '.' AS text FROM c GROUP BY trace_id, island, agent""")
def realize_events(spark: SparkSession, d: str) -> DataFrame:
    return realize.events_text(state(spark, d))


@query(f"""WITH a AS (SELECT trace_id, 0 AS part, 0 AS k, seq, text FROM ({ORACLE['realize_setting']}) UNION ALL SELECT trace_id, 1, island, '', text FROM ({ORACLE['realize_events']}))
SELECT trace_id, string_agg(text, ' ' ORDER BY part, k, seq, text) AS text FROM a GROUP BY 1""")
def realize_trace(spark: SparkSession, d: str) -> DataFrame:
    return realize.prose(state(spark, d))


# ---------------------------------------------------------------- language


@query()
def morph_decompose(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").where("text is not null").select(F.explode(letter_words(F.col("text"))).alias("word"))
    return morphology.decomposed(w).select("word", F.array_join("morphemes", " ").alias("morphemes"), F.array_join("kinds", " ").alias("kinds"), "known")


@query()
def verifier_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    v = grammar.verified(table(spark, d, "documents"))
    return v.select("doc_id", F.explode("diagnostics").alias("x")).select("doc_id", "x.check", "x.start", "x.end", "x.text")


@query()
def claims(spark: SparkSession, d: str) -> DataFrame:
    v = grammar.verified(table(spark, d, "documents"))
    return v.select("doc_id", F.explode("claims").alias("x")).select("doc_id", "x.subject", "x.relation", "x.object", "x.confidence").distinct()


@query()
def parseable_rate(spark: SparkSession, d: str) -> DataFrame:
    v = grammar.verified(table(spark, d, "documents"))
    return v.where("n_sentences > 0").select("doc_id", F.round(F.col("n_clean") / F.col("n_sentences"), 6).alias("rate"))


@query()
def noun_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = grammar.phrases(table(spark, d, "documents"))
    return p.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("sentence", "clause").alias("n_clauses"))


@query()
def content_stem_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(letter_words(F.col("text"))).alias("word"))
    return morphology.content_stems(w, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def claim_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each prose text of a trace against those of its event sentences alone."""
    s = load_state(spark, d, Catalog())
    full = grammar.verified(realize.prose(s), "trace_id")
    e = realize.events_text(s).groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "text"))), lambda x: x["text"]), " ").alias("text"))
    return grammar.claim_overlap(full, grammar.verified(e, "trace_id"), "trace_id")


# ---------------------------------------------------------------- streaming


@query("SELECT user_id, max_by(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY 1")
def stream_current_state(spark: SparkSession, d: str) -> DataFrame:
    s = live.read_stream(spark, f"{d}/events.parquet")
    g = s.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))
    return live.finished(g, "complete")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return live.finished(live.windows(live.read_stream(spark, f"{d}/events.parquet"), "ts", "1 day", ["event_type"], late="60 days"), "complete")


@query("SELECT DISTINCT trace_id, event_id, action FROM trace_events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = live.read_stream(spark, f"{d}/trace_events.parquet").select("trace_id", "event_id", "action")
    return live.finished(live.deduplicated(s, ["trace_id", "event_id", "action"]), "append")


@query("SELECT DISTINCT trace_id, action FROM trace_events")
def stream_firing_memo(spark: SparkSession, d: str) -> DataFrame:
    s = live.read_stream(spark, f"{d}/trace_events.parquet").select("trace_id", "action")
    return live.finished(live.fired_once(s, "trace_id", "action"), "append")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return live.sessions(table(spark, d, "events"), "ts", "12 hours", ["user_id"])


# ---------------------------------------------------------------- sinks


@query(f"WITH {EV}, {ROLES} SELECT trace_id, count(*) AS n_events FROM ev GROUP BY 1")
def trace_corpus_sink(spark: SparkSession, d: str) -> DataFrame:
    """Nested trace records written as JSON lines and read back."""
    s = state(spark, d)
    path = f"{live.shared_folder(spark)}/traces"
    sinks.trace_corpus(s, realize.prose(s), path)
    return sinks.read_trace_corpus(spark, path).select("trace_id", F.size("events").cast("long").alias("n_events")).where("n_events > 0")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL")
def resume_append_sink(spark: SparkSession, d: str) -> DataFrame:
    """Two appends of overlapping parts give each key once."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    path = f"{live.shared_folder(spark)}/resumed"
    sinks.append_missing(t.where("score is null") if "score" in t.columns else t, path, "doc_id")
    sinks.append_missing(t, path, "doc_id")
    return spark.read.parquet(path).select("doc_id")
