"""Corpus, text, conversation, metric and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, sampling, sequences, similarity
from ..sources import corpora
from .queries import query, table

L = T.LETTERS
TOK = f"regexp_extract_all(text, '[{L}]+|[0-9]+|[^\\s{L}0-9]')"
WS = "list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"
LW = f"regexp_extract_all(lower(text), '[{L}]+')"
DOCS = "docs AS (SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source").where("text is not null")


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 500")
def doc_min_length(spark: SparkSession, d: str) -> DataFrame:
    return corpora.min_length(table(spark, d, "documents"), 500).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND coalesce(lower(filter), '') <> 'discard'")
def blank_discard_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpora.kept(table(spark, d, "documents")).select("doc_id")


@query("""SELECT source, CASE WHEN (('0x' || left(md5(CAST(doc_id AS VARCHAR)), 7))::BIGINT % 100) < 95 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM documents
WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND (source IN ('factoids', 'sentences') OR length(text) >= 200) GROUP BY 1, 2""")
def source_union_split(spark: SparkSession, d: str) -> DataFrame:
    return corpora.split_table(table(spark, d, "documents"), min_chars=200).groupBy("source", "split").agg(F.count("*").alias("n"))


@query(f"WITH {DOCS} SELECT doc_id, array_to_string({TOK}, ' ') AS tokens FROM docs")
def word_tokenise(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(T.word_tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {DOCS} SELECT doc_id, len({TOK}) + coalesce(list_sum(list_transform(list_filter({TOK}, lambda t: regexp_full_match(t, '[0-9]+')), lambda t: length(t) - 1)), 0)::INTEGER AS n FROM docs")
def digit_split(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.size(T.split_digits(T.word_tokens(F.col("text")))).cast("long").alias("n"))


_ENDS = " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 2} THEN '{e}'" for e, *_ in T.ENDINGS)
_WORDS = f"words AS (SELECT unnest({LW}) AS w FROM docs)"


@query(f"WITH {DOCS}, {_WORDS}, u AS (SELECT w, count(*) AS n FROM words GROUP BY 1) SELECT w, n, CASE {_ENDS} ELSE '' END AS ending, left(w, length(w) - length(CASE {_ENDS} ELSE '' END)) AS stem FROM u")
def stem_strip(spark: SparkSession, d: str) -> DataFrame:
    # distinct words first: each is analysed once
    u = docs(spark, d).select(F.explode(T.letter_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return u.select("w", "n", T.ending(F.col("w")).alias("ending"), T.stem(F.col("w")).alias("stem"))


@query(f"WITH {DOCS}, {_WORDS}, u AS (SELECT left(w, length(w) - length(CASE {_ENDS} ELSE '' END)) AS stem FROM words) SELECT stem, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 5")
def stem_freq(spark: SparkSession, d: str) -> DataFrame:
    u = docs(spark, d).select(F.explode(T.letter_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return u.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n")).where("n >= 5")


_POS = " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 2} THEN '{p}'" for e, p, *_ in T.ENDINGS)


@query(f"WITH {DOCS}, {_WORDS} SELECT CASE {_POS} ELSE 'other' END AS pos, count(*) AS n FROM words GROUP BY 1")
def pos_histogram(spark: SparkSession, d: str) -> DataFrame:
    u = docs(spark, d).select(F.explode(T.letter_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return u.groupBy(T.pos_of(F.col("w")).alias("pos")).agg(F.sum("n").alias("n"))


@query("SELECT item_id, " + "".join("replace(" for _ in T.X_SYSTEM) + "question" + "".join(f", '{a}', '{b}')" for a, b in T.X_SYSTEM.items()) + " AS question FROM factual_qa")
def x_system(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "factual_qa").select("item_id", T.from_x_system(F.col("question")).alias("question"))


def _grams(words: str, n: int) -> str:
    return f"list_transform(generate_series(1, greatest(len({words}) - {n - 1}, 0)), lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' '))"


@query(f"WITH {DOCS}, t AS (SELECT doc_id, {WS} AS w FROM docs), g AS (SELECT doc_id, w, {_grams('w', 3)} AS g FROM t) SELECT doc_id, round(CASE WHEN len(w) < 4 THEN 0.0 ELSE 1 - len(list_distinct(g)) / len(g) END, 6)::DOUBLE AS rate FROM g")
def repetition3(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("w", T.white_tokens(F.col("text"))).select("doc_id", F.round(T.repetition_rate(F.col("w"), 3), 6).alias("rate"))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, {LW} AS w FROM docs), g AS (SELECT doc_id, w, {_grams('w', 4)} AS g FROM t) SELECT doc_id, round(CASE WHEN len(w) < 5 THEN 0.0 ELSE 1 - len(list_distinct(g)) / len(g) END, 6)::DOUBLE AS rate FROM g")
def repetition4_letters(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("w", T.letter_words(F.col("text"))).select("doc_id", F.round(T.repetition_rate(F.col("w"), 4), 6).alias("rate"))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, {WS} AS w FROM docs) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '[{L}]', '', 'g'), '\\p{{L}}'))) / len(w) END, 6)::DOUBLE AS rate FROM t")
def foreign_char_rate(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.round(T.foreign_rate(F.col("text")), 6).alias("rate"))


@query(f"WITH {DOCS} SELECT doc_id, round(least(1.0, greatest(0.0, (len({WS}) - 50) / 100.0)), 6)::DOUBLE AS excess FROM docs")
def length_excess(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.round(T.length_excess(F.col("text")), 6).alias("excess"))


@query("""WITH d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\\S')) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM d""")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = docs(spark, d).withColumn("s", T.sentences(F.col("text")))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query(f"""WITH {DOCS}, q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(question), '[{L}]+'), lambda w: length(w) >= 6)) AS qw, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(answer, ' ')), '[{L}]+'), lambda w: length(w) >= 3)) AS aw FROM factual_qa)
SELECT item_id, len(qw) AS n_question, len(aw) AS n_answer, len(list_intersect(qw, aw)) AS n_common FROM q""")
def content_presence(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "factual_qa")
    qw = F.array_distinct(F.filter(T.letter_words(F.col("question")), lambda w: F.length(w) >= 6))
    aw = F.array_distinct(F.filter(T.letter_words(F.array_join("answer", " ")), lambda w: F.length(w) >= 3))
    return q.select("item_id", F.size(qw).cast("long").alias("n_question"), F.size(aw).cast("long").alias("n_answer"), F.size(F.array_intersect(qw, aw)).cast("long").alias("n_common"))


@query(f"""WITH t AS (SELECT source, doc_id, {TOK} AS w FROM documents WHERE text IS NOT NULL), f AS (SELECT source, doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t),
n AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS off FROM f)
SELECT source, off // 64 AS block, string_agg(tok, ' ' ORDER BY off) AS tokens FROM n GROUP BY 1, 2 HAVING count(*) = 64""")
def block_pack(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("source", "doc_id", T.word_tokens(F.col("text")).alias("w"))
    return sequences.block_pack(t, "source", "doc_id", "w", 64).select("source", "block", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {DOCS} SELECT doc_id, array_to_string(list_transform({LW}, lambda w: CASE WHEN regexp_matches(w, '(o|a|oj|aj)$') AND w <> 'la' THEN w || 'n' ELSE w END), ' ') AS phrase FROM docs")
def accusative_phrase(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.accusative(F.array_join(T.letter_words(F.col("text")), " ")).alias("phrase"))


@query("""WITH u(k, w) AS (VALUES (1,'unu'),(2,'du'),(3,'tri'),(4,'kvar'),(5,'kvin'),(6,'ses'),(7,'sep'),(8,'ok'),(9,'naŭ')), n AS (SELECT DISTINCT l_partkey % 1000 AS n FROM lineitem)
SELECT n, CASE WHEN n = 0 THEN 'nul' ELSE concat_ws(' ', CASE n // 100 WHEN 0 THEN NULL WHEN 1 THEN 'cent' ELSE (SELECT w FROM u WHERE k = n // 100) || 'cent' END,
 CASE (n % 100) // 10 WHEN 0 THEN NULL WHEN 1 THEN 'dek' ELSE (SELECT w FROM u WHERE k = (n % 100) // 10) || 'dek' END, (SELECT w FROM u WHERE k = n % 10)) END AS words FROM n""")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select((F.col("l_partkey") % 1000).alias("n")).distinct()
    return n.select("n", T.number_words(F.col("n")).alias("words"))


@query("SELECT o_orderkey, regexp_replace(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '(\\d)(\\d{3})$', '\\1 \\2') AS price FROM orders")
def thousands_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.thousands(F.floor("o_totalprice")).alias("price"))


@query(f"WITH {DOCS} SELECT doc_id, upper(left(text, 1)) || substr(text, 2) AS text FROM docs")
def capitalise_first(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.capitalise_first(F.col("text")).alias("text"))


# ---------------------------------------------------------------- conversations and answers


@query("""WITH c AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, lower(trim(role)) AS role, coalesce(text, '') AS text FROM conversations ORDER BY conv_id, turn, created_at, role, text)
SELECT conv_id, string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn) AS chat, count(*) AS n FROM c GROUP BY 1""")
def chat_format(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id", "turn").orderBy("created_at", "role", F.col("text").asc_nulls_last())
    c = table(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    line = F.concat(F.lit("<|"), F.lower(F.trim("role")), F.lit("|>"), F.coalesce("text", F.lit("")))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.count("*").alias("n"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("chat"), "n")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) AS rn FROM (SELECT DISTINCT conv_id, turn, lower(role) AS role, text FROM conversations)) WHERE rn <= 200")
def chat_source_cap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower("role").alias("role"), "text").distinct()
    return sampling.capped(c, ["role"], ["conv_id", "turn", F.col("text").asc_nulls_last()], 200)


@query("""SELECT q.item_id, count(DISTINCT d.doc_id) AS n_docs FROM (SELECT DISTINCT item_id, lower(a) AS a FROM (SELECT item_id, unnest(answer) AS a FROM factual_qa) WHERE length(a) > 0) q LEFT JOIN documents d ON contains(lower(d.text), q.a) GROUP BY 1""")
def answer_check(spark: SparkSession, d: str) -> DataFrame:
    # the answers are one fixed table (size checked): each text is run once through the automaton of all
    q = table(spark, d, "factual_qa").select("item_id", F.explode("answer").alias("a")).where(F.length("a") > 0).distinct()
    hits = similarity.containing(table(spark, d, "documents"), "doc_id", "text", q, "item_id", "a")
    n = hits.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return q.select("item_id").distinct().join(n, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("""SELECT item_id, try_cast(coalesce(nullif(regexp_extract(question, '####\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1), ''),
 list_extract(regexp_extract_all(lower(question), '(?:respondo estas|answer is|estas)\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1), -1), list_extract(regexp_extract_all(question, '(-?[0-9]+(?:\\.[0-9]+)?)', 1), -1)) AS DOUBLE) AS answer FROM factual_qa""")
def math_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "factual_qa").select("item_id", T.numeric_answer(F.col("question")).alias("answer"))


@query("""WITH q AS (SELECT item_id, unnest(list_transform(answer, lambda x: try_cast(x AS DOUBLE))) AS a, list_transform(regexp_extract_all(question, '[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS n FROM factual_qa WHERE category = 'aritmetiko'), s AS (SELECT item_id, a, list_sum(n) AS b FROM q WHERE len(n) >= 2)
SELECT item_id, max(round(CASE WHEN a = b THEN 1.0 ELSE exp(-least(abs(a - b) / greatest(abs(b), 1e-9), 10.0)) END, 6)) AS score FROM s GROUP BY 1""")
def math_close(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "factual_qa").where("category = 'aritmetiko'")
    n = F.transform(F.regexp_extract_all("question", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("double"))
    s = q.withColumn("n", n).where(F.size("n") >= 2).select("item_id", F.explode("answer").alias("a"), F.aggregate("n", F.lit(0.0), lambda x, y: x + y).alias("b"))
    return s.groupBy("item_id").agg(F.max(F.round(T.closeness(F.col("a").try_cast("double"), F.col("b")), 6)).alias("score"))


# ---------------------------------------------------------------- metrics


@query("SELECT source, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM documents GROUP BY 1")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(table(spark, d, "documents"), ["source"], F.col("score").cast("double"))


@query("""WITH v AS (SELECT event_type, value FROM events), a AS (SELECT avg(value) m, var_samp(value) v, count(*) n FROM v WHERE event_type = 'click'), b AS (SELECT avg(value) m, var_samp(value) v, count(*) n FROM v WHERE event_type = 'view')
SELECT round(CASE WHEN a.n < 2 OR b.n < 2 OR a.v + b.v <= 0 THEN NULL ELSE (a.m - b.m) / sqrt((a.v + b.v) / 2) END, 6) AS d FROM a, b""")
def cohen_d(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events")
    return metrics.cohen_d(v, F.col("event_type") == "click", F.col("event_type") == "view", F.col("value")).select(F.round("d", 6).alias("d"))


@query("""WITH p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1)
SELECT count(*) AS pairs, sum(CASE WHEN a > b THEN 1 ELSE 0 END)::BIGINT AS wins FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_wins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    return metrics.paired_wins(p, "a", "b")


@query("""WITH q AS (SELECT item_id, category, (CASE WHEN item_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN item_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN item_id % 7 <> 0 THEN 1 ELSE 0 END) >= 2 AS hit FROM factual_qa)
SELECT coalesce(category, 'TOTAL') AS category, count(*) AS n, sum(hit::INT)::BIGINT AS hits, round(avg(hit::INT), 6) AS accuracy FROM q GROUP BY ROLLUP(category)""")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "factual_qa")
    passes = [(F.col("item_id") % k != 0).cast("int") for k in (3, 5, 7)]
    return metrics.accuracy_rollup(q.withColumn("hit", (sum(passes[1:], passes[0]) >= 2)), "category", "hit")


@query("SELECT round(exp(avg(value)), 6) AS perplexity FROM (SELECT value / 100 AS value FROM events)")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.round(F.exp(F.avg(F.col("value") / 100)), 6).alias("perplexity"))


@query("""WITH w AS (SELECT word FROM (SELECT lang, word FROM common_words) GROUP BY 1), seen AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[A-Za-zĈĉĜĝĤĥĴĵŜŝŬŭ]+')) AS word FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS total, count(s.word) AS seen FROM w LEFT JOIN seen s USING (word)""")
def vocabulary_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "common_words").select("word").distinct()
    seen = docs(spark, d).select(F.explode(T.letter_words(F.col("text"))).alias("word")).distinct().withColumn("hit", F.lit(1))
    return w.join(seen, "word", "left").agg(F.count("*").alias("total"), F.count("hit").alias("seen"))


@query("WITH r AS (SELECT event_id, user_id, CASE WHEN value > 40 THEN NULL ELSE value END AS v FROM events) SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY user_id)), 6) AS reward FROM r")
def nan_to_batch_mean(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 40, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return r.select("event_id", F.round(metrics.nan_to_mean("v", "user_id"), 6).alias("reward"))


@query("SELECT event_id, round(0.5 * value / 100 + 0.3 * (CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) - 0.2 * least(value / 50, 1), 6) AS reward FROM events")
def weighted_reward(spark: SparkSession, d: str) -> DataFrame:
    parts = {"value": (0.5, F.col("value") / 100), "click": (0.3, (F.col("event_type") == "click").cast("double")), "size": (-0.2, F.least(F.col("value") / 50, F.lit(1.0)))}
    return table(spark, d, "events").select("event_id", F.round(metrics.weighted(parts), 6).alias("reward"))


# ---------------------------------------------------------------- sampling by hash, vectors

_U = "((('0x' || left(md5(CAST({0} AS VARCHAR) || '{1}'), 8))::BIGINT + 0.5) / 4294967296.0)"


@query(f"SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(-ln({_U.format('event_id', 'w')}) / (value + 1), 9), event_id)::INTEGER AS rn FROM events) WHERE rn <= 3")
def weighted_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted_sample(table(spark, d, "events"), "user_id", "event_id", F.col("value") + 1, 3, "w").select("user_id", "event_id", "rn")


@query(f"SELECT user_id, max_by(event_id, (round(value / 10 - ln(-ln({_U.format('event_id', 'g')})), 9), event_id)) AS event_id FROM events GROUP BY 1")
def softmax_gumbel(spark: SparkSession, d: str) -> DataFrame:
    return sampling.softmax_pick(table(spark, d, "events"), "user_id", "event_id", F.col("value"), 10.0, "g")


@query("""WITH e AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS a, e.vec_id AS b, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cos FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT a, b, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cos, 9) DESC, b) AS rn FROM p) WHERE rn <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cosine_topk(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


@query("""WITH n AS (SELECT label, vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
p AS (SELECT a.label, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS c FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, round(avg(c), 5) AS mean FROM p GROUP BY 1""")
def pairwise_cosine_mean(spark: SparkSession, d: str) -> DataFrame:
    return similarity.mean_pairwise(table(spark, d, "embeddings"), "label", "embedding").select("label", F.round("mean", 5).alias("mean"))


@query("""WITH m AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 6) AS mean FROM m GROUP BY 1, 2""")
def mean_piece_vector(spark: SparkSession, d: str) -> DataFrame:
    return similarity.mean_vector(table(spark, d, "embeddings"), "label", "embedding")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT min(vec_id) AS m FROM e), t AS (SELECT list_transform(generate_series(1, 64), lambda i: a.v[i] - b.v[i] + c.v[i]) AS v FROM e a, e b, e c, k WHERE a.vec_id = k.m AND b.vec_id = k.m + 1 AND c.vec_id = k.m + 2)
SELECT vec_id, round(list_cosine_similarity(e.v, t.v), 6) AS cos FROM e, t, k WHERE vec_id > k.m + 2 ORDER BY round(list_cosine_similarity(e.v, t.v), 9) DESC, vec_id LIMIT 5""")
def analogy_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    m = e.agg(F.min("vec_id")).first()[0] or 0
    return similarity.analogy(e, "vec_id", "embedding", m, m + 1, m + 2, 5)
