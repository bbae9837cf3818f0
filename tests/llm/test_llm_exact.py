"""The vectorised operators against brute force and round trips."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velkora.llm import bpe, forms, garble, leaks, neardup, queries
from velkora.llm import codepoints as C

WORD = re.compile(r"[^\W_]+")


FRACTIONS = {unicodedata.normalize("NFKC", c): c for c in "½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞⅑⅒↉"}


def slow_form(s: str) -> str:
    t = unicodedata.normalize("NFC", "".join(C._folded(c) for c in s.replace("\r\n", "\n")))
    return re.sub(r"(?<![0-9⁄])[0-9]⁄[0-9]{1,2}(?![0-9⁄])", lambda m: FRACTIONS.get(m[0], m[0]), t)


def slow_fold(s: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFD", slow_form(s)) if not unicodedata.combining(c)).lower()
    return re.sub(r"([cghjsu])x", r"\1", t)


def unify(texts):
    return C.encode(*C.unify(*C.decode(pa.array(texts, pa.string())))).to_pylist()


alphabet = st.text(st.sampled_from("aeoscĉŝüﬁＡо́̂̈̀\r\n\t  ​­가ᄀ₁½x1１20⁄⁄"), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(alphabet, max_size=6))
def test_form_equals_the_slow_one(texts):
    got = unify(texts)
    assert got == [slow_form(t) for t in texts]
    assert unify(got) == got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=20).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)), max_size=5))
def test_decode_round_trip(texts):
    assert C.encode(*C.decode(pa.array(texts, pa.string()))).to_pylist() == texts


def test_decode_of_slices_and_nulls():
    a = pa.array(["ĉu", None, "", "abc", "🌍"])
    assert C.encode(*C.decode(a.slice(1, 4))).to_pylist() == ["", "", "abc", "🌍"]
    assert C.encode(*C.decode(pa.chunked_array([a, a]))).to_pylist()[5:7] == ["ĉu", ""]


def test_looks_alike(spark):
    rows = [(1, "La ŝipo"), (2, "Lа ŝipo"), (3, "La ŝipo"), (4, "La ŝipo"), (5, "la ŝipo"), (6, "La sipo"), (7, "La\nŝipo"), (8, None), (9, " "), (10, "​"), (11, "La sxipo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id_a, r.id_b) for r in forms.same_look_pairs({"t": (df, "doc_id", "text")}).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert dict(forms.consistent_form(df).collect())[2] == "La ŝipo"
    assert dict(forms.consistent_form(df).collect())[8] is None


def test_fractions_look_like_their_digits(spark):
    rows = [(1, "½ l"), (2, "1⁄2 l"), (3, "１⁄２ l"), (4, "11⁄2 l"), (5, "1/2 l"), (6, "⅒ l"), (7, "1⁄10 l"), (8, "C₆"), (9, "C6")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id_a, r.id_b) for r in forms.same_look_pairs({"t": (df, "doc_id", "text")}).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (6, 7)]


def test_many_copies_and_one_variant(spark):
    """100 000 copies of a text and one variant: a pair a copy, no pair of copies."""
    df = spark.range(100_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, "Lа ŝipo").otherwise("La ŝipo").alias("text"))
    got = forms.same_look_pairs({"t": (df, "doc_id", "text")})
    assert got.count() == 100_000 and got.where("id_a <> 5 and id_b <> 5").count() == 0


def test_forms_of_documents_and_questions(spark):
    sf = "/root/testdata/sf0.001"
    want = {(t, r[0]): r[1] if r[1] is None else slow_form(r[1]) for t, i, c in (("documents", "doc_id", "text"), ("factual_qa", "item_id", "question")) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, c).collect()}
    assert {(r.tbl, r.id): r.form for r in queries.p4_forms(spark, sf).collect()} == want


TOKENIZERS = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = TOKENIZERS.Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return bpe.encoder_of(open(bpe.vocabulary_path(), "rb").read()), t


@settings(max_examples=150, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(text=st.text(max_size=40).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
def test_bpe_ids(both, text):
    enc, ref = both
    ids = enc.encode(text)
    assert enc.decode(np.array(ids, np.int64)).decode("utf-8") == text
    if all(unicodedata.category(c) not in ("Cn", "Co") for c in text):  # the libraries' Unicode versions differ there
        assert ids == ref.encode(text, add_special_tokens=False).ids


def test_bpe_on_joined_tokens(both):
    enc, ref = both
    rng = random.Random(3)
    longer = [t for t in enc.token if len(t) > 2]
    for _ in range(2000):
        try:
            text = b"".join(rng.choice(longer) for _ in range(4)).decode()
        except UnicodeDecodeError:
            continue
        assert enc.encode(text) == ref.encode(text, add_special_tokens=False).ids
    for text in ("a" * 5000, "abab" * 900, "<|endoftext|>", " \n\n\t x"):
        assert enc.encode(text) == ref.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark):
    df = spark.createDataFrame([(1, "Saluton, mondo!"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    ids = bpe.encode_corpus(df)
    assert sorted((r.doc_id, len(r.ids) > 0) for r in ids.collect()) == [(1, True), (2, False), (3, False), (3, False)]
    assert dict(bpe.decode_corpus(ids).collect()) == {1: "Saluton, mondo!", 2: "", 3: ""}


@pytest.mark.parametrize("enc", ["cp1252", "iso8859_1", "cp1250", "cp1251", "mac_roman", "cp437"])
def test_garbled_utf8_is_found_and_restored(enc):
    good = "„Ĉiu ĝardeno estas bela,“ diris ŝi kontraŭ la ĵaŭdo. Müller ißt café."
    bad = garble._read(good.encode("utf-8"), enc)
    back, n, left = garble.restore(bad)
    assert n > 5 and left == 0 and back == good
    mixed = "Ŝi ĝojas. " + bad + " Ĉu ne?"
    assert garble.restore(mixed)[0] == "Ŝi ĝojas. " + good + " Ĉu ne?"


def test_single_byte_garbling_and_sound_names():
    good = "la preĝejo kontraŭ ŝia biciklo ĉe la vilaĝo"
    bad = good.encode("iso8859_3").decode("cp1252")
    assert garble.restore(bad)[0] == good
    lost = good.encode("ascii", "replace").decode()
    assert garble.spans(lost) and garble.spans("la pre�ejo")
    for sound in ("Kjærsø estas vilaĝo, kie ĝi staras, kun ½ litro da lakto por Sørvåg.", "ĈU? jes. https://a.example/x?b=1&c=ĉ", "Eble cxiu sxipo", "“¿Qué?” dijo la niña", "La ｓｔｒａｔｏ de Каto", "", None):
        assert garble.spans(sound) == []


def test_words_of_capitals_are_judged_one_by_one():
    bad = "LA ŜIPO STARAS ĈE LA MARO".encode("iso8859_3").decode("cp1252")
    assert [bad[s:e] for s, e, _ in garble.spans(bad)] == ["Þ", "Æ"]
    assert garble.restore(bad)[0] == "LA ŜIPO STARAS ĈE LA MARO"
    for sound in ("En 1931 BJØRLUND venis al ÅNGDAL.", "BJØRLUND, ÅNGDAL, KJÆRSØ kaj SØRVÅG estas nomoj."):
        assert garble.spans(sound) == []


def test_one_form_is_judged_by_its_place_alone():
    assert garble.spans("antaÅ\xad la domo") and garble.spans("la fiЕќisto") and garble.spans("pokazaЕ‚ worek")
    assert garble.spans("Å\xadngdal estas urbo") == [] and garble.spans("LA DOМ« diris li") == []
    long = "antaÅ\xad la domo " + "va\xadpo\xadro " * 500  # many scattered characters elsewhere change nothing
    assert [(s, e) for s, e, _ in garble.spans(long)] == [(4, 6)]


def test_the_quick_look_loses_nothing(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text]
    quick = [garble.spans(t) for t in texts]
    monkeypatch.setattr(garble, "_suspicious", lambda t: True)
    assert [garble.spans(t) for t in texts] == quick


def test_the_quick_look_over_batches_loses_nothing(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    texts += ["", "ŝĈ", "a?b", "?", "aĈ", "Ã©", "Å", None, "x", "ŭ"]
    quick = garble.suspicious_rows(pa.array(texts, pa.string()))
    assert all(q or not t or not garble._suspicious(t) for q, t in zip(quick, texts, strict=True))
    assert quick.mean() < 0.5
    sliced = garble.suspicious_rows(pa.array(texts, pa.string()).slice(5000))
    assert all(a or not b for a, b in zip(sliced, [bool(garble.spans(t)) for t in texts[5000:]], strict=True))


def jaccard_pairs(texts, k, s, least):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(slow_form(t or "").lower())
        if len(w) >= max(least, k):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"vorto{i}" for i in range(300)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t[: len(t) // 2] + [rng.choice(vocab)] + t[len(t) // 2 :]
            texts[len(texts) + 1] = " ".join(t)
    for _ in range(40):  # a hot group of copies
        texts[len(texts) + 1] = texts[1]
    texts[len(texts) + 1], texts[len(texts) + 2], texts[len(texts) + 3] = None, "", "tro mallonga"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members, links = neardup.near_duplicates(df, k=3, similarity=0.5, min_words=20)
    got = {(r.doc_a, r.doc_b) for r in neardup.document_pairs(members, links).collect()}
    assert got == jaccard_pairs(texts, 3, 0.5, 20)
    per = {r.doc_id: r for r in neardup.classes(members, links).collect()}
    assert per[1].class_id == 1 and per[1].n_copies >= 41


def test_covering_family_has_no_gap(spark):
    """Sketches that differ in at most RADIUS coordinates share a table key; the keys of tables never mix."""
    rng = np.random.default_rng(0)
    g, w = neardup.GROUPS, neardup.WIDTH
    a = rng.integers(0, 1 << 16, (300, g * w), dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        b[i, rng.choice(g * w, neardup.RADIUS, replace=False)] ^= np.uint64(1)
    blocks = lambda m: np.bitwise_or.reduce(m.reshape(300, g, w) << (np.arange(w, dtype=np.uint64) * np.uint64(16)), axis=2).view(np.int64)
    rows = [(*map(int, x), *map(int, y)) for x, y in zip(blocks(a), blocks(b), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{s}{i} long" for s in "xy" for i in range(g)))
    keys = df.select(*[F.array(*neardup.table_keys([F.col(f"{s}{i}") for i in range(g)])).alias(s) for s in "xy"])
    got = keys.select(F.size(F.array_intersect("x", "y")).alias("n"), F.size(F.array_distinct("x")).alias("m"), "x", "y").collect()
    assert len(got) == 300 and all(r.n > 0 and r.m == g * w for r in got)
    assert all({v for v in r.x} & {v for v in r.y} == {p for p, q in zip(r.x, r.y, strict=True) if p == q} for r in got)


def test_repeated_ids_are_one_document(spark):
    t = [" ".join(f"vorto{i}" for i in range(j, j + 40)) for j in (0, 100, 2)]
    rows = [(1, t[0]), (1, t[1]), (2, t[2]), (3, t[0]), (3, t[0]), (4, t[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, links = neardup.near_duplicates(df, k=3, similarity=0.5, min_words=20)
    assert sorted(r.id for r in members.collect()) == [1, 2, 3, 4]
    got = [(r.doc_a, r.doc_b) for r in neardup.document_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and (2, 3) in got and ((1, 4) in got) != ((1, 3) in got)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "ĉirk ŝip dom arb lag".split() for b in ("o", "on", "oj", "a", "e")]
    bench = {10001 + i: " ".join(rng.choice(vocab) for _ in range(30)) for i in range(5)}
    asks = {1: "Kiu urbo estas ĉefurbo de Selferio?", 2: "Kiu urbo estas ĉefurbo de Selferio?", 3: "Kiom estas 34 plus 96?", 4: "?"}
    docs = {1: "Enkonduko. " + bench[10001], 2: " ".join(bench[10002].split()[5:17]), 3: " ".join(bench[10002].split()[5:16]), 4: "KIU URBO – estas cxefurbo de\nSELFERIO", 5: "Kiu urbo estas ĉefurbo de Melbario?", 6: None, 7: "", 8: "kiom estas 34 plus 97"}
    docs[9] = bench[10003].replace("ĉ", "cx").replace("ŝ", "s").upper()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(bench.items()), "item_id long, text string")
    q = spark.createDataFrame(list(asks.items()), "item_id long, question string")

    def windows(text, k):
        w = WORD.findall(slow_fold(text or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, t in docs.items():
        want |= {(i, j) for j, x in bench.items() if windows(t, 12) & windows(x, 12)}
        for j, x in asks.items():
            n = len(WORD.findall(slow_fold(x)))
            if n and windows(x, n) & windows(t, n):
                want.add((i, j))
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, b, q).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, b, q, max_broadcast=1).collect()} == want
    other = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, b, q, exact=False).collect()}
    assert (5, 1) in other and (8, 3) in other and (4, 1) not in other


def test_leaks_by_join_equal_those_by_broadcast(spark):
    b = [(10001, "La 3 katoj de Melbario vidis 4 hundojn kaj 3 birdojn apud la rivero en Selferio hodiaŭ")]
    q = [(1, "Kiu urbo estas ĉefurbo de Selferio?"), (2, "Kiom estas 34 plus 96?"), (3, "Kiom estas 5 plus 5?"), (4, None), (5, "")]
    d = [(1, b[0][1]), (2, b[0][1].replace("3", "7")), (3, b[0][1].replace("3 birdojn", "9 birdojn")), (4, "Kiu urbo estas ĉefurbo de Melbario? Kiom estas 34 plus 97?"), (5, "kiom estas 6 plus 6"), (6, q[1][1]), (7, None), (8, "")]
    docs = spark.createDataFrame(d, "doc_id long, text string")
    items = spark.createDataFrame(b, "item_id long, text string"), spark.createDataFrame(q, "item_id long, question string")
    for exact in (True, False):
        rows = [{(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, *items, exact=exact, max_broadcast=m).collect()} for m in (leaks.MAX_BROADCAST_CHARS, 1)]
        assert rows[0] == rows[1] and rows[0], exact
    assert (2, 10001) in rows[1] and (1, 10001) not in rows[1] and (6, 2) not in rows[1]


def test_names_that_open_an_item_are_slots(spark):
    b = [(10001, "Maria havas 12 pomojn kaj Petro havas 7 pirojn en la sako")]
    d = [(1, "Anna havas 30 pomojn kaj Karlo havas 9 pirojn en la sako"), (2, b[0][1]), (3, "Anna havas 30 pomojn kaj Karlo havas 30 pirojn en la sako")]
    docs = spark.createDataFrame(d, "doc_id long, text string")
    items = spark.createDataFrame(b, "item_id long, text string"), None
    for m in (leaks.MAX_BROADCAST_CHARS, 1):
        assert {r.doc_id for r in leaks.leaked_items(docs, *items, exact=False, max_broadcast=m).collect()} == {1}
        assert {r.doc_id for r in leaks.leaked_items(docs, *items, max_broadcast=m).collect()} == {2}


def test_rows_of_numbers_are_no_templates(spark):
    """A window of slots alone costs no expansion and is a copy of nothing but itself."""
    b = [(10001 + i, " ".join(str(j + i) for j in range(40))) for i in range(200)]
    d = [(1, " ".join(str(1000 + j) for j in range(5000))), (2, b[7][1])]
    docs = spark.createDataFrame(d, "doc_id long, text string")
    items = spark.createDataFrame(b, "item_id long, text string"), None
    assert leaks.leaked_items(docs, *items, exact=False).collect() == []
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, *items).collect()}
    assert {d for d, _ in got} == {2} and (2, 10008) in got


def test_planted_reparameterised_items_are_found(spark):
    """Items of the tables with all numbers and names exchanged, one value for one value: recall of 0.9 at least."""
    sf, rng = "/root/testdata/sf0.01", random.Random(9)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    asks = [(r.item_id, r.question) for r in spark.read.parquet(f"{sf}/factual_qa.parquet").collect() if r.question]
    small = {w for _, t in bench + asks for w in WORD.findall(t) if w[:1].islower()}

    def other(text):
        new, words = {}, []
        for i, m in enumerate(re.finditer(r"[^\W_]+|[\W_]+", text)):
            w = m.group()
            if w.isascii() and w.isdigit():
                w = new.setdefault(w, str(10**6 + len(new) * 7919 + rng.randrange(100)))
            elif i and w[:1].isupper() and w.lower() not in small and w[1:].islower():
                w = new.setdefault(w, "Kvorlim" + "abcdefghijklmnop"[len(new) % 16] * (1 + len(new) // 16))
            words.append(w)
        return "".join(words) if new else None

    plant = [(i, x) for i, t in bench + asks if (x := other(t)) and len(WORD.findall(t)) >= 8]
    docs = spark.createDataFrame([(i, f"Antaŭa frazo. {x} Posta frazo.") for i, x in plant], "doc_id long, text string")
    tables = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(asks, "item_id long, question string")
    found = {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, *tables, exact=False).collect()}
    assert len(plant) > 100 and sum((i, i) in found for i, _ in plant) >= 0.9 * len(plant)
