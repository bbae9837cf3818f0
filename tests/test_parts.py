"""Small tests of sources, text functions, sequences, events, planning and streams."""

import json

import pytest
from pyspark.sql import functions as F

from velkora.functions import facts, grammar, morphology
from velkora.functions import text as T
from velkora.operators import closure, events, metrics, sampling, sequences, similarity
from velkora.plans import planner
from velkora.sources import corpora, sinks


def col(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()[0]


def test_text_functions(spark):
    assert col(spark, "La 12 katoj, ĉu?", T.word_tokens) == ["La", "12", "katoj", ",", "ĉu", "?"]
    assert col(spark, "x 120", lambda c: T.split_digits(T.word_tokens(c))) == ["x", "1", "2", "0"]
    assert col(spark, "cxapelo SXI", T.from_x_system) == "ĉapelo SXI"
    assert col(spark, "katojn", T.ending) == "ojn" and col(spark, "la", T.ending) == ""
    assert col(spark, "bona kato", T.accusative) == "bonan katon"
    assert col(spark, "kuri", lambda c: T.tense(c, "as")) == "kuras"
    assert col(spark, "a b c d a b c d", lambda c: T.repetition_rate(T.white_tokens(c), 3)) == pytest.approx(1 - 4 / 6)
    assert col(spark, "a b", lambda c: T.repetition_rate(T.white_tokens(c), 3)) == 0
    assert col(spark, "", lambda c: T.foreign_rate(c)) == 0
    assert col(spark, "12 #### 7", T.numeric_answer) == 7 and col(spark, "neniu", T.numeric_answer) is None
    assert col(spark, "kat o <w> dorm as <|eos|>", T.demorph) == "kato dormas"
    assert col(spark, "katoo", T.broken_value) and not col(spark, "kato", T.broken_value)
    assert spark.range(0, 1000).select(T.number_words(F.col("id")).alias("w")).where("id = 999").first()[0] == "naŭcent naŭdek naŭ"


def test_dates_and_quantities(spark):
    assert col(spark, "+1529-00-18T00:00:00Z", facts.partial_date) == "1529"
    assert col(spark, "+1529-07-00T00:00:00Z", facts.partial_date) == "1529-07"
    q = col(spark, "+3.5 km", facts.quantity)
    assert (q.amount, q.unit) == (3.5, "km")
    assert col(spark, "kelkaj", facts.quantity).amount is None


def test_sources(spark, tmp_path):
    (tmp_path / "7_web.jsonl").write_text(json.dumps({"text": "bona", "filter": "keep"}) + "\n\n" + json.dumps({"text": " ", "filter": None}) + "\n" + json.dumps({"text": "x", "filter": "Discard"}) + "\n", encoding="utf-8")
    (tmp_path / "3_web.jsonl").write_text(json.dumps({"text": "malalta"}) + "\n", encoding="utf-8")
    got = corpora.web_crawl(spark, f"{tmp_path}/*.jsonl", min_score=7)
    assert [r.text for r in got.collect()] == ["bona"]
    (tmp_path / "s.tsv").write_text("1\teo\tSaluton\n2\teo\n3\teo\t \n", encoding="utf-8")
    assert [r.text for r in corpora.sentence_tsv(spark, f"{tmp_path}/s.tsv").collect()] == ["Saluton"]
    (tmp_path / "book.txt").write_text("  libro  ", encoding="utf-8")
    assert [r.text for r in corpora.books(spark, f"{tmp_path}/book.txt").collect()] == ["libro"]
    assert corpora.mc4(spark, f"{tmp_path}/none") is None
    assert corpora.factoids(spark, f"{tmp_path}/none", f"{tmp_path}/3_web.jsonl").count() == 1
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        corpora.jsonl(spark, f"{tmp_path}/bad.jsonl", "text string").collect()
    with pytest.raises(ValueError):
        corpora.combined({})


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, t string")
    sinks.append_missing(a, f"{tmp_path}/t", "k")
    sinks.append_missing(a.unionByName(spark.createDataFrame([(3, "c")], "k long, t string")), f"{tmp_path}/t", "k")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2, 3]
    sinks.tagged_text({"x": a.select(F.col("t").alias("text"))}, f"{tmp_path}/tag")
    assert spark.read.parquet(f"{tmp_path}/tag").where("source = 'x'").count() == 3


def test_packing_keeps_order_and_drops_tail(spark):
    df = spark.createDataFrame([("s", 1, [1, 2, 3]), ("s", 2, []), ("s", 3, [4, 5, 6, 7, 8]), ("u", 1, [9])], "p string, i int, w array<int>")
    got = {(r.p, r.block): r.tokens for r in sequences.block_pack(df, "p", "i", "w", 3).collect()}
    assert got == {("s", 0): [1, 2, 3], ("s", 1): [4, 5, 6]}


def test_closure_on_cycles_and_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("n", None)], "src string, dst string")
    assert closure.closure(e).where("src = 'a'").count() == 2
    assert {r.node: r.comp for r in closure.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    path = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "src string, dst string")
    assert {r.comp for r in closure.components(path).collect()} == {"000"}


def test_property_at(spark):
    ch = spark.createDataFrame([(1, 2, "e", "s", "b"), (1, 5, "e", "s", "c")], "trace_id long, pos int, eid string, slot string, value string")
    init = spark.createDataFrame([(1, "e", "s", "a")], "trace_id long, eid string, slot string, value string")
    asks = spark.createDataFrame([(1, "e", "s", t) for t in (0, 2, 3, 6)], "trace_id long, eid string, slot string, t int")
    assert {r.t: r.value for r in events.property_at(ch, init, asks).collect()} == {0: "a", 2: "a", 3: "b", 6: "c"}
    born = spark.createDataFrame([(1, "e", 3)], "trace_id long, eid string, created_at int")
    assert {r.t: r.value for r in events.property_at(ch, init, asks, born).collect()} == {0: None, 2: None, 3: None, 6: "c"}


def test_metrics_and_sampling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r["mean"], r["std"]) for r in metrics.summary(df, ["k"], F.col("v")).collect()}
    assert got == {"a": (2, 2.0, 1.0), "b": (0, None, None)}
    assert metrics.cohen_d(df, F.col("k") == "a", F.col("k") == "b", F.col("v")).first()[0] is None
    u = spark.range(2000).select(sampling.uniform(F.col("id"), "x").alias("u"))
    lo, hi, mean = u.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < lo and hi < 1 and abs(mean - 0.5) < 0.03


def test_similarity_without_pairs(spark):
    df = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.0, 1.0]), (3, "g", [1.0, 0.0])], "id long, g string, v array<double>")
    assert similarity.mean_pairwise(df, "g", "v").first()["mean"] == pytest.approx(1 / 3)
    top = similarity.cosine_topk(df, "id", "v", F.col("id") == 1, 1).collect()
    assert [(r.a, r.b, r.cos) for r in top] == [(1, 3, 1.0)]


def test_planner(spark):
    start = spark.createDataFrame([(1, "at|a")], "trace_id long, fact string")
    step = [(1, "go", f"{x}{y}", [f"at|{x}"], [f"at|{y}"], [f"at|{x}"], 1) for x, y in ("ab", "bc", "ac", "cd")]
    acts = spark.createDataFrame(step, "trace_id long, action string, binding string, pre array<string>, add array<string>, del array<string>, cost int")
    cost = {r.fact: r.cost for r in planner.relaxed_costs(start, acts).collect()}
    assert cost == {"at|a": 0, "at|b": 1, "at|c": 1, "at|d": 2}
    goals = spark.createDataFrame([(1, "at|d"), (1, "at|z")], "trace_id long, goal string")
    got = {r.goal: (r.found, r.n_steps) for r in planner.search(start, acts, goals).collect()}
    assert got == {"at|d": (True, 2), "at|z": (False, 0)}


def test_accusative_of_all_words(spark, tmp_path):
    from velkora.plans import corpus_queries as Q

    text = "La ruĝa kato vidis la grandan hundon dum la du birdoj flugis super la malnova domo"
    spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(Q.accusative_phrase(spark, str(tmp_path)).collect())
    assert got == {1: "la ruĝan katon vidis la grandan hundon dum la du birdojn flugis super la malnovan domon", 3: ""}


def test_words_of_many_roots_are_known_and_flagged(spark):
    rows = [(1, "katdomo"), (1, "hundkatdomo"), (1, "hundkatdomarbo"), (1, "hundkatdomarboj"), (1, "qwertoj"), (1, "la"), (2, "hundokatodomoarbofloro")]
    got = {r.doc_id: (r.n_content, r.unknown_rate, r.n_long) for r in morphology.unknown_rates(spark.createDataFrame(rows, "doc_id long, word string"), "doc_id").collect()}
    assert got == {1: (5, 0.2, 2), 2: (1, 0.0, 1)}


def test_morphology():
    assert morphology.decompose("malgrandajn") == ["mal", "grand", "a", "j", "n"]
    assert morphology.decompose("bakistino") == ["bak", "ist", "in", "o"]
    assert morphology.decompose("la") == ["la"]
    assert [morphology.kind(m) for m in ("mal", "grand", "a", "j")] == ["prefix", "root", "ending", "ending"]
    assert morphology.known_stem("katoj") and not morphology.known_stem("qwertoj")


@pytest.mark.parametrize(
    ("text", "check"),
    [
        ("La bonaj kato dormas.", "np_agreement"),
        ("La katoj estas bona.", "predicate_agreement"),
        ("La kato vidas hundo.", "missing_accusative"),
        ("La kato dormas liton.", "intransitive_accusative"),
        ("Mi parolas kun amikon.", "preposition_case"),
        ("La kato de kato dormas.", "tautology"),
    ],
)
def test_grammar(text, check):
    found = [d[0] for c in grammar.CHECKS.values() for d in c(grammar.analyse(text))]
    assert check in found


def test_clean_sentence_and_claims(spark):
    text = "La bona kato vidas la grandan hundon. La kato estas bela. La kato dormas en la lito."
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")
    got = {r.doc_id: r for r in grammar.verified(df).collect()}
    assert got[1].n_clean == 3 and got[1].diagnostics == []
    assert {(c.subject, c.relation, c.object) for c in got[1].claims} == {("kat", "vid", "hund"), ("kat", "est", "bel"), ("kat", "dorm_en", "lit")}
    assert got[2].n_sentences == got[3].n_sentences == 0
