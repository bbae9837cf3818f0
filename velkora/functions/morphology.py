"""Esperanto morphology over a dictionary given as a parameter.

A word is analysed once: queries take distinct words first, run the Arrow function on
those and join back.  The built-in lists are a small stand-in for a full dictionary.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Closed-class words and affixes of the language.
PARTICLES = frozenset("la kaj sed aŭ ĉar ke se do nek nu ja jes ne ol plu tre tro tuj nun jam ankaŭ nur eĉ ĉi apenaŭ baldaŭ hodiaŭ hieraŭ morgaŭ almenaŭ preskaŭ kvazaŭ malgraŭ antaŭ anstataŭ ĉirkaŭ kontraŭ laŭ al de da el en ĝis inter je kun per po por post preter pri pro sen sub super sur tra trans apud ĉe dum ekster krom".split())
PRONOUNS = frozenset("mi vi li ŝi ĝi ni ili oni si ci".split())
CORRELATIVES = frozenset(a + b for a in ("ki", "ti", "i", "ĉi", "neni") for b in ("u", "o", "a", "e", "am", "al", "el", "om", "es"))
PREFIXES = ("mal", "ge", "re", "ek", "dis", "mis", "bo", "eks", "pra", "fi")
SUFFIXES = ("estr", "ist", "ej", "uj", "in", "id", "il", "ig", "iĝ", "ec", "aĵ", "ar", "er", "et", "eg", "em", "ebl", "end", "ind", "an", "ul", "um", "ad", "aĉ", "ant", "int", "ont", "at", "it", "ot")
ENDINGS = ("ojn", "ajn", "oj", "aj", "on", "an", "en", "as", "is", "os", "us", "o", "a", "e", "i", "u")
ROOTS = frozenset("""
akr akv alt am amik anas arb aĉet aŭd aŭt bak bat bel best bild bird biciklo blank blu boat bon botel bov branĉ bril bru brun brul best ĉap ĉas ĉef ĉen ĉeriz ĉeval danc dezert dir dolĉ dom dorm
elekt fadn fajr fal fam farm fer ferm festiv fiŝ flav flor flos flug foli fork fort fraz fromaĝ frukt fum gard gast glas glit grand gren griz haven heĝ herb histori hom horloĝ hund infan insul instru jak jun jar jong
kanton kant kap kaŝ kapitan kastel kat kest klar knab kolekt kolor komprenebl konstru korb kovr krest kresk kudr kuir kuler kur kuz kuŝ labor lag lamp larĝ lav leĝ leg leter lern libr lig lingv lit loĝ long lud
mal manĝ mapo map mar marŝ martel mastr metal metr mezur mir moder mond monuj mont montr muel mur muze najbar najl naĝ nav neĝ nest nov nub nuk ombr orn ov paĝ pan pas patr pens pens pentr pez pilk pir plan plant plen plor plum pluv poŝ pom pont pord port pren princ progres proksim prunt pur puŝ
rad rakont rapid regn reĝ ripar ripoz river romp rond ruĝ ruin sabl sag saĝ salt sciu sci sed seg seĝ sek sel sem send serĉ serv sid silent simil simpl skrib soldat sonĝ star stat steln stel stol ston strang strat stud sun ŝaf ŝanĝ ŝarĝ ŝat ŝip ŝlos ŝnur ŝose ŝpar ŝpin ŝran ŝtof ŝton ŝtorm ŝtup ŝu tabl tag tajlor tarif teatr tegment temp ten tol trajn tranĉ trem trov trist tur tut tranĉil uz valor val varm vek vel vend venk vent ver verd verk vetur vid vilaĝ vin vintr viv vojaĝ voj vort vulp zorg ĝard ĝoj ĝentil ĵet ĵurnal
""".split())


@dataclass(frozen=True)
class Dictionary:
    roots: frozenset[str] = ROOTS
    prefixes: tuple[str, ...] = PREFIXES
    suffixes: tuple[str, ...] = SUFFIXES
    max_roots: int = 3


def closed_class(word: str) -> bool:
    w = word[:-1] if word.endswith("n") and word[:-1] in PRONOUNS | CORRELATIVES else word
    w = w[:-1] if w.endswith("j") and w[:-1] in CORRELATIVES else w
    return w in PARTICLES or w in PRONOUNS or w in CORRELATIVES


def split_ending(word: str) -> tuple[str, str]:
    for e in ENDINGS:
        if word.endswith(e) and len(word) >= len(e) + 2:
            return word[: -len(e)], e
    return word, ""


#: Shortest stem that endings leave behind.
LEAST_STEM = 2
BASE_ENDINGS = ("as", "is", "os", "us", "o", "a", "e", "i", "u")


def endings(word: str) -> tuple[str, list[str]]:
    """(stem, [ending, j, n]): the accusative n goes first, then the plural j, then the ending."""
    tail = []
    for mark in ("n", "j"):
        if word.endswith(mark) and len(word) > LEAST_STEM + 1:
            tail.insert(0, mark)
            word = word[:-1]
    for e in BASE_ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= LEAST_STEM:
            return word[: -len(e)], [e, *tail]
    return word, tail


def split_in_order(stem: str, d: Dictionary) -> tuple[str, ...] | None:
    """Morphemes by the first way that works: a root; the longest prefix and the rest; the rest
    and the longest suffix; a root and the rest."""
    first = sorted(d.prefixes, key=len, reverse=True)
    last = sorted(d.suffixes, key=len, reverse=True)

    @functools.lru_cache(maxsize=None)
    def go(s: str) -> tuple[str, ...] | None:
        if not s or s in d.roots:
            return (s,) if s else ()
        ways = [(p, s[len(p) :], "") for p in first if s.startswith(p) and len(s) > len(p)]
        ways += [("", s[: -len(x)], x) for x in last if s.endswith(x) and len(s) > len(x)]
        ways += [(s[:i], s[i:], "") for i in range(LEAST_STEM, len(s) - LEAST_STEM + 1) if s[:i] in d.roots]
        for head, rest, tail in ways:
            if (r := go(rest)) is not None:
                return (*((head,) if head else ()), *r, *((tail,) if tail else ()))
        return None

    return go(stem)


def split_stem(stem: str, d: Dictionary) -> tuple[str, ...] | None:
    """Morphemes of a stem: a root, an affix and the rest, or a compound; fewest pieces win."""

    @functools.lru_cache(maxsize=None)
    def go(s: str, roots: int) -> tuple[str, ...] | None:
        if roots > d.max_roots:
            return None
        if s in d.roots:
            return (s,)
        best = None
        for p in d.prefixes:
            if s.startswith(p) and len(s) > len(p) + 1 and (r := go(s[len(p) :], roots)):
                best = min(filter(None, (best, (p, *r))), key=len)
        for x in d.suffixes:
            if s.endswith(x) and len(s) > len(x) + 1 and (r := go(s[: -len(x)], roots)):
                best = min(filter(None, (best, (*r, x))), key=len)
        for i in range(len(s) - 2, 1, -1):
            if s[:i] in d.roots:
                rest = s[i + 1 :] if s[i] == "o" and len(s) > i + 2 else s[i:]
                if r := go(rest, roots + 1):
                    best = min(filter(None, (best, (s[:i], *(("o",) if rest != s[i:] else ()), *r))), key=len)
        return best

    return go(stem, 1)


def decompose(word: str, d: Dictionary = Dictionary()) -> list[str]:
    """Morphemes of one word; a word that cannot be split keeps its stem whole."""
    return list(_cut(word.lower(), d))


@functools.lru_cache(maxsize=1 << 17)
def _cut(w: str, d: Dictionary) -> tuple[str, ...]:
    if closed_class(w) or not w.isalpha():
        return (w,)
    stem, end = endings(w)
    return (*(split_in_order(stem, d) or (stem,)), *end)


def kind(m: str, d: Dictionary = Dictionary()) -> str:
    """prefix, suffix, ending, particle or root, in that order of preference."""
    if m in d.prefixes:
        return "prefix"
    if m in d.suffixes:
        return "suffix"
    return "ending" if m in ENDINGS or m in ("j", "n") else "particle" if closed_class(m) else "root"


def known_stem(word: str, d: Dictionary = Dictionary()) -> bool:
    w = word.lower()
    return closed_class(w) or split_stem(split_ending(w)[0], d) is not None


@dataclass(frozen=True)
class Parse:
    """First root of a word with the affixes around it."""

    root: str
    prefixes: tuple[str, ...]
    suffixes: tuple[str, ...]


class Parser(Protocol):
    """Anything that parses a word; None where it cannot."""

    def parse(self, word: str) -> Parse | None: ...


@dataclass(frozen=True)
class DictionaryParser:
    d: Dictionary = Dictionary()

    def parse(self, word: str) -> Parse | None:
        w = word.lower()
        m = split_in_order(endings(w)[0], self.d) if w.isalpha() and not closed_class(w) else None
        at = next((i for i, x in enumerate(m or ()) if kind(x, self.d) == "root" or x in self.d.roots and x not in self.d.prefixes), None)
        return None if at is None else Parse(m[at], tuple(x for x in m[:at] if x in self.d.prefixes), tuple(x for x in m[at + 1 :] if x in self.d.suffixes))


@dataclass(frozen=True)
class TableParser:
    """A fixed table of parses (tests, or a lexicon with parses of its own)."""

    table: dict[str, Parse]

    __hash__ = object.__hash__

    def parse(self, word: str) -> Parse | None:
        return self.table.get(word.lower())


#: Most roots a dictionary table may bring to the executors.
MAX_ROOTS = 500_000


def dictionary_of(table: DataFrame, col: str = "root", base: Dictionary = Dictionary()) -> Dictionary:
    """A dictionary whose roots come from a table (a lexicon of bounded size, checked)."""
    rows = table.select(F.lower(col)).where(F.col(col).isNotNull()).distinct().limit(MAX_ROOTS + 1).collect()
    if len(rows) > MAX_ROOTS:
        raise ValueError(f"more than {MAX_ROOTS} roots")
    return replace(base, roots=frozenset(r[0] for r in rows))


def content_stems(words: DataFrame, key: str, col: str = "word", parser: Parser = DictionaryParser()) -> DataFrame:
    """(key, stem): prefixes and root of the content words of each key, two letters at least.

    ``words`` is (key, word); each distinct word is parsed once."""

    def run(batches):
        for b in batches:
            p = [parser.parse(w) for w in b[col]]
            yield pd.DataFrame({col: b[col], "stem": ["".join(x.prefixes) + x.root if x else None for x in p]})

    stems = words.select(col).where(F.col(col).isNotNull()).distinct().mapInPandas(run, f"{col} string, stem string")
    return words.join(stems.where("length(stem) >= 2"), col).select(key, "stem").distinct()


def decomposed(words: DataFrame, col: str = "word", d: Dictionary = Dictionary()) -> DataFrame:
    """(word, morphemes, kinds, known) of distinct words; null words are left out."""

    def run(batches):
        for b in batches:
            m = [decompose(w, d) for w in b[col]]
            yield pd.DataFrame({col: b[col], "morphemes": m, "kinds": [[kind(x, d) for x in y] for y in m], "known": [known_stem(w, d) for w in b[col]]})

    return words.select(col).where(F.col(col).isNotNull()).distinct().mapInPandas(run, f"{col} string, morphemes array<string>, kinds array<string>, known boolean")


def word_facts(words: DataFrame, col: str = "word", d: Dictionary = Dictionary()) -> DataFrame:
    """(word, known, root_pieces, content): of distinct words, for quality rates.

    ``root_pieces`` is the number of roots a known stem needs (0 where unknown), also beyond
    ``max_roots``: stems that split only so are known, and quality rates flag them;
    ``content`` is false for closed-class words and numbers."""

    def run(batches):
        for b in batches:
            pieces, known, content = [], [], []
            for w in b[col]:
                low = w.lower()
                c = not closed_class(low) and low.isalpha()
                stem = split_ending(low)[0]
                p = (split_stem(stem, d) or split_stem(stem, replace(d, max_roots=len(stem)))) if c else None
                pieces.append(sum(1 for m in p if m in d.roots and m not in d.prefixes and m not in d.suffixes) if p else 0)
                known.append(p is not None or not c)
                content.append(c)
            yield pd.DataFrame({col: b[col], "known": known, "root_pieces": pieces, "content": content})

    return words.select(col).where(F.col(col).isNotNull()).distinct().mapInPandas(run, f"{col} string, known boolean, root_pieces int, content boolean")


def unknown_rates(words: DataFrame, key: str, d: Dictionary = Dictionary()) -> DataFrame:
    """(key, n_content, unknown_rate, n_long): shares over (key, word) rows.

    Each distinct word is analysed once; counts join back before they are added up."""
    n = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    f = word_facts(n, "word", d)
    j = n.join(f, "word").where("content")
    g = j.groupBy(key).agg(F.sum("n").alias("n_content"), F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)).alias("u"), F.sum(F.when(F.col("root_pieces") > d.max_roots, F.col("n")).otherwise(0)).alias("n_long"))
    return g.select(key, "n_content", F.round(F.col("u") / F.col("n_content"), 6).alias("unknown_rate"), "n_long")
