"""Fitted operators on held-out texts, and odd input for every operator."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velkora.llm import bpe, forms, garble, languages, leaks, neardup, prose, queries, residue

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, id long, t string, label string, w int, form string"


@pytest.fixture(scope="module")
def common(spark):
    return spark.read.parquet(f"{SF}/common_words.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = "La kato dormas en la granda ĝardeno apud la rivero. " * 8000
    rows = [(1, None, None, 1, "x", None, 1, None), (2, "", "", 2, "x", "", 2, ""), (3, " \n\t", "xx", 3, None, "", 3, ""), (4, long, "eo", 4, "", "", 4, ""), (4, long, "eo", 4, "", "", 4, ""), (5, "a", None, 5, "", "", 5, ""), (None, "La kato", "eo", 6, "", "", 6, ""), (7, "\x00﻿​", "eo", 7, "", "", 7, ""), (8, "x" * 60000, "pl", 8, "", "", 8, "")]
    return spark.createDataFrame(rows, ODD)


def operators(df, common, spark):
    b = spark.createDataFrame([(10001, "La kato dormas en la granda ĝardeno apud la rivero kaj kantas")], "item_id long, text string")
    q = spark.createDataFrame([(1, None), (2, ""), (3, "Kiu dormas?")], "item_id long, question string")
    m, links = neardup.near_duplicates(df, k=3, similarity=0.5, min_words=20)
    return {
        "languages": languages.document_languages(df, common),
        "mislabelled": languages.mislabelled(df, common),
        "segments": languages.segments(df),
        "garbled": garble.garbled_documents(df),
        "restored": garble.restored(df),
        "pairs": neardup.document_pairs(m, links),
        "classes": neardup.classes(m, links),
        "same": forms.same_look_pairs({"d": (df, "doc_id", "text")}),
        "forms": forms.consistent_form(df),
        "notprose": prose.not_prose(df, common),
        "stats": prose.text_statistics(df, common),
        "ids": bpe.encode_corpus(df),
        "leaks": leaks.leaked_items(df, b, q),
        "residue": residue.residue_documents(df),
        "scores": residue.residue_scores(df),
    }


def test_odd_rows_have_defined_results(spark, odd, common):
    got = {k: v.collect() for k, v in operators(odd, common, spark).items()}
    assert len(got["ids"]) == odd.count() and [len(r.ids) for r in got["ids"] if r.doc_id in (1, 2)] == [0, 0]
    assert len(got["stats"]) == len(got["scores"]) == len(got["forms"]) == odd.count()
    assert {r.doc_id for r in got["mislabelled"]} == set() and {r.doc_id for r in got["languages"]} == {4}
    assert [(r.doc_id, r.n_copies) for r in got["classes"]] == [(4, 1)]
    assert got["garbled"] == got["restored"] == got["same"] == got["pairs"] == got["residue"] == []
    assert [r.doc_id for r in got["stats"] if r.is_prose is None] and {r.doc_id for r in got["notprose"]} <= {5, 8}


def test_empty_tables(spark, odd, common):
    for name, df in operators(odd.limit(0), common, spark).items():
        assert df.collect() == [], name


def test_repeated_and_tied_rows_are_stable(spark, odd, common):
    a = {k: sorted(map(repr, v.collect())) for k, v in operators(odd, common, spark).items()}
    b = {k: sorted(map(repr, v.collect())) for k, v in operators(odd.repartition(5), common, spark).items()}
    assert a == b


def test_labels(spark):
    rows = [("eo", "eo"), (" EO", "eo"), ("epo_Latn", "eo"), ("eo-Latn", "eo"), ("ido", "io"), ("deu", "de"), ("xx", None), ("und", None), ("", None), (None, None), ("ja", "ja")]
    df = spark.createDataFrame(rows, "lang string, want string")
    assert df.withColumn("got", languages.label_code(F.col("lang"))).where("not (got <=> want)").count() == 0


def test_language_runs(spark, common):
    eo = "La malnova kapitano rakontis longan historion pri la insulo. La infanoj aŭskultis lin."
    en = "The old captain measured the broken clock behind the mill. Nobody lost the key to the cellar."
    rows = [(1, eo, "eo"), (2, eo, "en"), (3, f"{eo} {en}", "eo"), (4, "La amiko ĉiam diris: « guten Abend », kaj ridis kun la aliaj infanoj apud la rivero.", "eo"), (5, en, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang) for r in languages.mislabelled(df, common).collect()}
    assert got == {(2, "eo"), (3, "eo"), (3, "en"), (5, "en")}


def test_a_sure_sentence_of_the_related_language_stands(spark, common):
    en = "The old captain measured the broken clock behind the mill. Nobody lost the key to the cellar. My sister bought three green apples at the market before the rain began."
    fr = "La petite fille cherche son chapeau dans le jardin de sa grand-mère. Nous avons mangé du pain avec les voisins hier soir. Les oiseaux chantent sous la pluie et personne ne les écoute."
    de = "Der alte Lehrer öffnete gestern langsam die schwere Tür des Hauses."
    two = "Der alte Lehrer öffnete die Tür. Er hatte den Schlüssel verloren."
    es = "El viejo pescador perdió ayer las llaves de su casa junto al río."
    eo = "La malnova kapitano rakontis longan historion pri la insulo. La infanoj aŭskultis lin. Ŝi aĉetis tri verdajn pomojn en la vendejo."
    hat = "„Draseldormelio feliĉe purigas la pilkon,“ diris la tajloro."
    rows = [(1, f"{en} {de} {en}", "en"), (2, f"{fr} {es} {fr}", "fr"), (3, f"{en} {two} {en}", "en"), (4, f"{eo} {hat} {eo}", "eo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang) for r in languages.mislabelled(df, common).collect()}
    assert got == {(1, "en"), (1, "de"), (2, "fr"), (2, "es"), (3, "en"), (3, "de")}
    runs = [(r.seq, r.lang) for r in sorted(languages.segments(df.where("doc_id = 1")).collect(), key=lambda r: r.seq)]
    assert runs == [(0, "en"), (1, "de"), (2, "en")]


def test_language_accuracy_on_labelled_documents(spark, common):
    """Documents of sf0.01 whose label is one of the seven: most labels are right."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    d = languages.document_languages(df, common).where("n_held = 1 and label is not null")
    same = d.agg(F.avg((F.col("label") == F.col("lang")).cast("int"))).first()[0]
    assert same > 0.85


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("Kara {{nomo}}, bonvenon en nia vilaĝo.", True),
        ("La prezo estas %PREZO% por ĉiu.", True),
        ("Skribu al [INSERT NAME] morgaŭ.", True),
        ("Via retumilo ne subtenas skriptojn; bonvolu aktivigi ilin por daŭrigi al /a/1", True),
        ("Bona teksto antaŭe. Eraro 404: la petita paĝo /x/2 ne estis trovita sur ĉi tiu servilo", True),
        ("Lorem ipsum Velin ceru orna lectumum lectum amenium vestu ameni lectumque. Ipsumque magnatis nibus velinis.", True),
        ("Please enable JavaScript in your browser settings and reload to view this content.", True),
        ("La aro {1, 2, 5} havas tri elementojn, klarigis la gasto.", False),
        ("La eraro 404 estas tiel konata, ke la soldato faris ŝercon pri ĝi.", False),
        ("Presistoj nomas tian senenhavan tekston lorem ipsum, klarigis la tajloro.", False),
        ("JavaScript estas programlingvo, kiun la princo instruas en kurso de 3 semajnoj.", False),
        ("Laŭ la enketo 39 % de la legantoj neniam uzas skriptojn, diris la ŝuisto [7].", False),
        (".kir { padding: 94px; margin: 3px }", False),
        ("La signo {nomo} en la ŝablono estas poste anstataŭigata.", False),
        ("Oni skribas „{{titolo}}“ en la dosiero, kaj la programo metas tien la nomon.", False),
        ("The sign `{name}` is explained in this chapter of the book.", False),
        ("La bovoj staras sur la kampo ${loko}.", True),
        ("Accès refusé : vous n’avez pas le droit de consulter le fichier /kir/11 ici", True),
    ],
)
def test_residue(text, hit):
    assert bool(residue.scores(pa.array([text]))[0][0] >= residue.THRESHOLD) is hit


@pytest.mark.parametrize(
    ("text", "is_prose"),
    [
        ("La kato dormas en la ĝardeno. La hundo ne vidas ĝin, ĉar la nokto estas malluma.", True),
        ("La kvieta rivero fluas al la maro,\nLa nuboj flosas super la montoj,\nKaj la infano kantas ĉe la pordo", True),
        ("– Kie vi estis?\n– Mi laboris en la kampo kun mia frato.\n– Do venu nun en la domon.", True),
        ("| Nomo | Prezo |\n| --- | --- |\n| pomo | 12 % |\n| piro | 13:40 |", False),
        ("- pomo de Melbario\n- 12 g da salo\n- Tumkano (1934)\n- ruĝa korbo\n- pano kaj vino", False),
        ("2021-06-03T01:47 [DBG] bar.pel=26852 id=3cfe4c99\n2023-05-18T10:23 [DBG] tum=99299 id=374e697f", False),
        ("pomo, piro, vino, korbo, kato, hundo, domo, monto, maro, rivero, ponto, strato, urbo", False),
        ("^^^^°°°°§§§§####----****>>>>", False),
    ],
)
def test_prose(spark, common, text, is_prose):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert prose.text_statistics(df, common).first().is_prose is is_prose


def test_nearest_profile_is_exact():
    """The nearest of many profiles, also where the Hellinger order is another."""
    rng = np.random.default_rng(5)
    n = int(prose.GROUPS[-1])
    part = lambda k: np.concatenate([rng.dirichlet(np.full(int(m), rng.choice([0.05, 0.3, 1.0])), k) for m in np.diff(prose.GROUPS)], axis=1)
    x, profiles = part(4000), part(400)
    assert profiles.shape[1] == n
    assert (prose.nearest(x, profiles) == prose.divergence(x, profiles).argmin(1)).mean() > 0.9999
    p, q = rng.random(100_000), rng.random(100_000) ** 8
    js = prose._entropy((p + q) / 2) - (prose._entropy(p) + prose._entropy(q)) / 2
    assert (js >= (np.sqrt(p) - np.sqrt(q)) ** 2 / 2 - 1e-12).all()


def test_wrapped_lines_follow_to_the_end():
    ok = np.array([1, 0, 0, 0, 0, 0, 0, 0, 1], bool)
    link = np.array([1, 1, 1, 1, 1, 0, 1, 1], bool)
    assert prose._followed(ok, link).tolist() == [True] * 6 + [False] * 2 + [True]
    assert prose._followed(ok[::-1], link[::-1])[::-1].tolist() == [True] + [False] * 5 + [True] * 3


def test_registered_queries_run(spark):
    for name, f in queries.queries().items():
        assert f(spark, "/root/testdata/sf0.001").count() >= 0, name


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    root = Path(prose.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "import llm" not in p.read_text() and ".llm" not in p.read_text(), p
