"""Template residue, filler and messages of sites: positive-unlabelled naive Bayes.

Tokens are the words of a text in comparison form (numbers are one token) and pairs of
neighbouring words.  The shape of an unfilled placeholder (``SHAPES``) is a feature like any
other: it is read as three words -- opening sign, name, closing sign -- each of its own
shape, and of another kind where the text speaks of it (it stands in quotation marks, or a
word for such signs leads up to it).  A naive Bayes model gives each token a log-odds
weight; ``train.py`` fits it by expectation-maximization from trusted records (``TRUSTED``,
placeholders of sound texts), records that speak of such things (``SPOKEN``) and unlabelled
passages.  A text is scored passage by passage in one linear sweep: its best run of
consecutive tokens, so a message is found amid good text, across wrapped lines and
without punctuation around it, while words that only speak of such things pull a run
down.  A document is a case if its best run reaches ``THRESHOLD``.

Defined results: null, empty and blank texts score 0 and are no case; repeated rows give
a row each in ``residue_scores``; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from . import prose
from .batches import batch_of, map_text

MODEL = Path(__file__).with_name("models") / "residue.npz"
U64 = np.uint64
THRESHOLD = 22.0
NUMBER = U64(0x11)
#: A letter no corpus language writes: words that stand for the parts of a placeholder begin with it.
PART = "ꙮ"

#: Features of the model: shapes that a placeholder may have (braces, percent signs and brackets
#: of sets, tables, code, quantities and notes have others).
SHAPES = (
    r"\{\{\{?\s*[\w.#/-]+\s*(?:\|[\w\s.]*)?\}?\}\}",
    r"\$\{\s*[\w.]+\s*\}",
    r"(?<![\w{$%])\{\s*[^\W\d_][\w.]*\s*\}(?!\})",
    r"\{%-?\s*[^\W\d_][\w.\s]*?-?%\}",
    r"<%[=-]?\s*[^\W\d_][\w.\s]*?%>",
    r"(?<![\w%])%[A-ZĈĜĤĴŜŬ][A-ZĈĜĤĴŜŬ0-9_.]+%(?!\w)",
    r"%\(\s*[^\W\d_][\w.]*\s*\)[sdSD]",
    r"(?<!\w)__[^\W\d_][\w.]*?__(?!\w)",
    r"##\s*[^\W\d_][\w.]*\s*##",
    r"@@\s*[^\W\d_][\w.]*\s*@@",
    r"\[\[\s*[^\W\d_][\w.]*\s*\]\]",
    r"\[[A-ZĈĜĤĴŜŬ][A-ZĈĜĤĴŜŬ0-9.]*(?:[ _\n][A-ZĈĜĤĴŜŬ0-9.]+)+\]",
    r"(?:&lt;|<)\s*(?!/?(?:b|i|u|p|a|br|hr|em|ul|ol|li|td|tr|th|div|span|img|pre|sub|sup|code)\b)[^\W\d_][\w.]*\s*(?:&gt;|>)",
)

# Trusted records, written for this engine: what sites and servers tell their visitors,
# and filler, in the corpus languages.
TRUSTED = """
Please enable JavaScript in your browser to view this page
This site requires JavaScript and cookies to work
Error 404 the page you are looking for could not be found on this server
Sorry, the page has been moved or no longer exists
Internal server error, something went wrong while processing your request
Access denied, you do not have permission to access this file on this server, please log in
Your session has expired, please log in again to continue
This site is under maintenance and will be back soon
Too many requests from your address, wait some seconds and retry
Warning: could not connect to the database in line of script
This is placeholder text that will be replaced later, your content goes here, click the edit button
Bonvolu ŝalti JavaScript en via retumilo por vidi ĉi tiun paĝon
Via retumilo ne subtenas skriptojn, bonvolu aktivigi ilin por daŭrigi
Eraro 404: la petita paĝo ne estis trovita sur ĉi tiu servilo
Ni bedaŭras, sed la paĝo ne plu ekzistas aŭ translokiĝis
Interna eraro de la servilo okazis dum traktado de via peto
Aliro malpermesita: vi ne havas la rajton vidi ĉi tiun dosieron sen ensaluto
Via sesio eksvalidiĝis, bonvolu ensaluti denove
Ĉi tiu retejo nun estas riparata kaj baldaŭ denove estos alirebla
Tro da petoj venis de via adreso, atendu kelkajn sekundojn antaŭ nova provo
La datumbazo ne respondas, provu denove post kelkaj minutoj
Ĉi tiu provizora teksto montras kiel la fina enhavo de la paĝo aspektos
Ĉi tie aperos la teksto de via artikolo, kiam vi estos skribinta ĝin
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzeigen zu können
Fehler 404: Die angeforderte Seite wurde auf diesem Server nicht gefunden
Interner Serverfehler: Ihre Anfrage konnte nicht bearbeitet werden
Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an
Diese Seite wird gerade gewartet und ist bald wieder erreichbar
Hier entsteht der Text Ihrer Seite, dies ist nur ein Blindtext
Veuillez activer JavaScript dans votre navigateur pour afficher le contenu de cette page
Erreur 404 : la page que vous cherchez est introuvable sur ce serveur
Une erreur interne du serveur est survenue, veuillez réessayer plus tard
Votre session a expiré, veuillez vous reconnecter
Ce texte provisoire sera remplacé par le contenu définitif de votre page
Active JavaScript en su navegador para poder ver el contenido de esta página
Error 404: la página que busca no se ha encontrado en este servidor
Error interno del servidor al procesar su solicitud, inténtelo más tarde
Su sesión ha caducado, inicie sesión de nuevo
Este texto de relleno será sustituido por el contenido de su página
Aby zobaczyć tę stronę, musisz włączyć obsługę JavaScript w swojej przeglądarce
Błąd 404: nie znaleziono strony na tym serwerze
Wewnętrzny błąd serwera, spróbuj ponownie później
Twoja sesja wygasła, zaloguj się ponownie
Tutaj pojawi się wkrótce treść strony, to jest tylko tekst zastępczy
Voluntez aktivigar JavaScript en vua navigilo por vidar ca pagino
Eroro 404: la pagino ne trovesis sur ca servilo
Zugriff verweigert: Sie haben keine Berechtigung, die Datei auf diesem Server anzusehen
Die angeforderte Seite wurde verschoben oder existiert nicht mehr
Zu viele Anfragen von Ihrer Adresse, bitte versuchen Sie es in einigen Sekunden erneut
Die Datenbank antwortet nicht, bitte versuchen Sie es später noch einmal
Accès refusé : vous n'avez pas le droit de voir ce fichier, veuillez vous connecter
Cette page a été déplacée ou n'existe plus
Ce site est en maintenance et sera bientôt de retour
Trop de requêtes de votre adresse, attendez quelques secondes avant de réessayer
La base de données ne répond pas, réessayez dans quelques minutes
Acceso denegado: no tiene permiso para ver este archivo en el servidor
La página se ha movido o ya no existe
Este sitio está en mantenimiento y volverá pronto
Demasiadas solicitudes desde su dirección, espere unos segundos antes de intentarlo
La base de datos no responde, inténtelo de nuevo en unos minutos
Odmowa dostępu: nie masz uprawnień do tego pliku na serwerze
Strona została przeniesiona albo już nie istnieje
Strona jest w trakcie naprawy i wkrótce wróci
Zbyt wiele żądań z twojego adresu, odczekaj kilka sekund i spróbuj ponownie
Baza danych nie odpowiada, spróbuj ponownie za kilka minut
Aceso refuzita: vu ne havas la yuro vidar ca dokumento
Interna eroro di la servilo, probez itere pos kelka minuti
Lorem ipsum dolor sit amet, consectetur adipiscing elit
""".strip().splitlines()

# Records, written for this engine, that only speak of such things ({} is a placeholder of any shape).
SPOKEN = """
La signo {} en la ŝablono estas anstataŭigata per la nomo de la uzanto
Oni skribas „{}“, kaj la programo metas tie la daton
La lokokupilo {} montras, kie poste aperos la prezo
En la lernolibro la variablo {} signifas la titolon
The sign {} in the template stands for the name of the reader
Write "{}" and the program puts the date there
The placeholder {} is replaced when the letter is printed
Das Zeichen {} steht in der Vorlage für den Namen
Der Platzhalter „{}“ wird beim Drucken ersetzt
Le signe {} désigne dans le modèle le nom du lecteur
On écrit « {} » et le programme y met la date
El signo {} representa en la plantilla el nombre del lector
La variable «{}» indica la fecha
Znak {} oznacza w szablonie imię czytelnika
Zmienna „{}” to data listu
La signo {} esas la nomo dil lektero
""".strip().splitlines()

# Words for such signs in the corpus languages, in comparison form.
SIGNS = frozenset(
    "signo signon signoj variablo variablon sablono lokokupilo marko "
    "sign signs placeholder placeholders variable token tag marker "
    "zeichen platzhalter vorlage signe marqueur signo plantilla marcador znak zmienna szablon".split()
)
_QUOTES = frozenset("\"'`„“”«»‘’‹›")


@functools.lru_cache(maxsize=1)
def _shape():
    import regex

    return regex.compile("|".join(f"(?P<s{i}>{p})" for i, p in enumerate(SHAPES)))


@functools.lru_cache(maxsize=1)
def _before():
    import regex

    return regex.compile(r"(\w+)\W*$")


def placeholders(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, shape, spoken of) of every placeholder."""
    out = []
    for m in _shape().finditer(text):
        s, e = m.span()
        quoted = text[:s].rstrip(" ")[-1:] in _QUOTES and text[e:].lstrip(" ")[:1] in _QUOTES if s and e < len(text) else False
        word = None if quoted else _before().search(text, max(0, s - 40), s)
        told = quoted or word is not None and "".join(c for c in unicodedata.normalize("NFD", word[1].lower()) if not unicodedata.combining(c)) in SIGNS
        out.append((s, e, int(m.lastgroup[1:]), told))
    return out


def as_words(text: str, hits: list[tuple[int, int, int, bool]]) -> str:
    """The text with every placeholder written as the three words of its shape."""
    out, at = [], 0
    for s, e, k, told in hits:
        kind = chr(97 + k) + "q" * told
        out += [text[at:s], f" {PART}o{kind} {PART}{'q' * told} {PART}e{kind} "]
        at = e
    return "".join([*out, text[at:]])


_OPEN = frozenset("{[<%$_#@&")


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word tokens, row offsets, placeholders by row) of cleaned texts."""
    c, o = prose.clean(arr)
    texts = C.encode(c, o).to_pylist()
    marks = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if not _OPEN.isdisjoint(t) and (hits := placeholders(t)):
            marks[i] = len(hits)
            texts[i] = as_words(t, hits)
    if marks.any():
        c, o = C.decode(pa.array(texts, pa.string()))
    f, fo = C.fold_spelling(c, o)
    s, e, woff = C.words(f, fo)
    h = C.word_hashes(f, s, e)
    if len(s):
        digit = (f >= 48) & (f <= 57)
        h[digit[s]] = NUMBER
    return h, woff, marks


def pairs(h: np.ndarray) -> np.ndarray:
    """Token of each word with the next one (the last has no partner and is never used)."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            out[:-1] = C.mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    return out


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray, float]:
    m = np.load(MODEL, allow_pickle=False)
    return m["token"], m["weight"].astype(np.float64), float(m["unknown"])


def _weights(h: np.ndarray, token: np.ndarray, weight: np.ndarray, other: float) -> np.ndarray:
    p = np.searchsorted(token, h)
    p[p == len(token)] = 0
    return np.where(token[p] == h, weight[p], other)


def scores(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(best run of tokens, placeholders) of each row."""
    token, weight, unknown = model()
    h, woff, marks = tokens(arr)
    n = len(woff) - 1
    best = np.zeros(n)
    if len(h):
        row = np.repeat(np.arange(n), np.diff(woff))
        w = _weights(h, token, weight, unknown)
        last = np.zeros(len(h), bool)
        last[woff[1:][np.diff(woff) > 0] - 1] = True
        two = np.where(last, 0.0, _weights(pairs(h), token, weight, 0.0))
        # best run: a word belongs with the pair that starts at the word before it
        v = w.copy()
        v[1:] += two[:-1]
        total = np.cumsum(v)
        # row-wise running minimum of what came before: shift rows far apart, then accumulate
        before = total - v
        lift = row * (np.abs(v).sum() + 1.0)
        low = np.minimum.accumulate(before - lift) + lift
        np.maximum.at(best, row, total - low)
    return best, marks


def residue_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_placeholders, is_residue) of every row."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        best, marks = scores(b.column(1))
        return batch_of(id=b.column(0), score=best, n=marks)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = map_text(src, "t", fn, "id long, score double, n long")
    return out.select(F.col("id").alias(id_col), "score", F.col("n").alias("n_placeholders"), (F.col("score") >= THRESHOLD).alias("is_residue"))


def residue_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of the documents with a placeholder, filler or message that stands as such."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        best, _ = scores(b.column(1))
        hit = best >= THRESHOLD
        return batch_of(id=b.column(0).filter(pa.array(hit))) if hit.any() else None

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null and id is not null")
    return map_text(src, "t", fn, "id long").select(F.col("id").alias(id_col)).distinct()
