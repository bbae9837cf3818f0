"""Text read with the wrong encoding: find the garbled spans and restore them.

For every pair (encoding the text was in, encoding it was read with) the garbled form of
each letter and mark that a text of the corpus languages can hold is precomputed.  All
forms stand in one multi-pattern automaton that is run once over a text.

* Forms of two or more characters (a UTF-8 letter read as single bytes, once or twice)
  do not occur in sound text; a hit is garbling.
* Forms of one character (one single-byte table read as another) may be sound in other
  words, so a hit counts only by its place: a mark or control character inside a word,
  a letter of no corpus language inside a word of small letters, a capital after a small
  letter.  A name with a foreign letter (capital first, the rest small) is left alone.
* Letters lost for good show as U+FFFD, or as a question mark inside or before a word.

Only matched spans are replaced; correct text between them stays as it is.

Defined results: null, empty and blank texts are never garbled and restore to
themselves; repeated rows give a row each in ``restored`` and one per id in
``garbled_documents``; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from .batches import batch_of, map_text

# Letters outside ASCII of the corpus languages, and typographic marks.
LETTERS = "ĉĝĥĵŝŭĈĜĤĴŜŬäöüßÄÖÜàâæçèéêëîïôœùûüÿÀÂÇÈÉÊËÎÏÔŒÙÛáéíóúñüÁÉÍÓÚÑąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
MARKS = "“”„‚‘’–—…«»¿¡½€° "
#: Letters that sound words of the corpus languages hold (æ and ÿ are too rare in them).
SOUND = frozenset(LETTERS) - frozenset("æÿ")
#: The commoner of them, to choose between encoding pairs that explain as much.
FREQUENT = frozenset("ĉĝĥĵŝŭáéíóúñäöüßàèêçąćęłńśżźĈĜŜŬ“”–’")
SINGLE_BYTE = ("iso8859_3", "cp1252", "iso8859_1", "cp1250", "iso8859_2", "iso8859_15", "mac_roman", "cp437", "cp850", "cp852")
READ_AS = ("cp1252", "iso8859_1", "cp1250", "iso8859_2", "iso8859_3", "iso8859_15", "cp1251", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r")
_NO_INK = frozenset("­​‌‍⁠﻿")
#: Look-alikes of Latin letters, and small forms of such capitals (disguised, then lowered).
_LIKE = frozenset("аеорсухіјѕАВЕКМНОРСТХІЈЅονΑΒΕΖΗΙΚΜΝΟΡΤΥΧﬁﬂ" "вкмнтζηικτυχ")
#: Capitals of names from other languages, which no pair of the corpus languages explains alone.
_NAMES = frozenset("ÅØÆÞÐ")
LOST, NBSP = "�", "\xa0"


def _read(data: bytes, enc: str) -> str:
    """Decode as a lenient reader does: bytes the table lacks become control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@functools.lru_cache(maxsize=1)
def patterns() -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]], dict[str, str]]:
    """(garbled sequence -> {encoding it was read with -> original} for longer forms, pair -> {character -> original},
    longer forms that sound text may hold, restored only beside certain ones)."""
    long: dict[str, dict[str, str]] = {}
    for ch in LETTERS + MARKS:
        for enc in READ_AS:
            once = _read(ch.encode("utf-8"), enc)
            long.setdefault(once, {}).setdefault(enc, ch)
            if enc in ("cp1252", "iso8859_1", "cp1250"):
                long.setdefault(_read(once.encode("utf-8"), enc), {}).setdefault(enc, ch)
    long = {k: v for k, v in long.items() if len(k) > 1}
    weak = {k: next(iter(v.values())) for k, v in long.items() if all(c in _NO_INK or c in _LIKE or c in SOUND for c in k) or k[0] in _LIKE and all(c in _NO_INK or c in _LIKE or c == NBSP for c in k[1:])}
    long = {k: v for k, v in long.items() if k not in weak}
    single: dict[str, dict[str, str]] = {}
    for was in SINGLE_BYTE:
        for enc in READ_AS:
            if was == enc:
                continue
            m = {}
            for ch in LETTERS + MARKS:
                try:
                    g = _read(ch.encode(was), enc)
                except UnicodeEncodeError:
                    continue
                if g != ch:
                    m.setdefault(g, ch)
            if m:
                single[f"{was}>{enc}"] = m
    return long, single, weak


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    long, single, _ = patterns()
    a = ahocorasick.Automaton()
    for k, v in long.items():
        a.add_word(k, (k, next(iter(v.values()))))
    for m in single.values():
        for g in m:
            if g not in a and g not in SOUND and g not in MARKS and g not in _NO_INK and g not in _LIKE:
                a.add_word(g, (g, ""))
    for g in (LOST, "?"):
        if g not in a:
            a.add_word(g, (g, ""))
    a.make_automaton()
    return a


def _url_like(text: str, i: int) -> bool:
    s = max(text.rfind(" ", 0, i), text.rfind("\n", 0, i), text.rfind("\t", 0, i)) + 1
    return "/" in text[s:i]


_RARELY_INWORD = frozenset("©®°§€™²·")


def _single_hit(text: str, i: int) -> bool:
    """Is the lone character at ``i`` garbling, by its place in the word?"""
    c = text[i]
    before = text[i - 1] if i else " "
    if i > 1 and not before.isalpha() and before in automaton() and text[i - 2].isalpha():
        before = text[i - 2]  # two garbled letters side by side
    after = text[i + 1] if i + 1 < len(text) else " "
    if c == LOST or "\x80" <= c <= "\x9f":
        return True
    if c == "?":
        if not after.isalpha() or _url_like(text, i):
            return False
        if before.isalpha() and text[i + 2 : i + 3] in (" ", "\n", "") and (text[i + 3 : i + 4].isupper() or text[i + 3 : i + 4] == ""):
            return False  # the last letter and the mark changed places
        return before.isalpha() or (before in " \n„“(«" or i == 0) and after.islower()
    if not c.isalpha():
        if c in _RARELY_INWORD:
            return before.islower() and after.islower()
        return before.isalpha() and after.isalpha() or before.isalpha() and after in " ,.;!?\n" and c not in "•…" or after.islower() and not before.isalnum() and c not in "•"
    # a letter of no corpus language: sound only in a name (capital first, the rest small)
    s = i
    while s and (text[s - 1].isalpha() or text[s - 1] in _NO_INK):
        s -= 1
    e = i + 1
    while e < len(text) and (text[e].isalpha() or text[e] in _NO_INK):
        e += 1
    word = "".join(x for x in text[s:e] if x not in _NO_INK)
    if any(x in _LIKE for x in word):
        return False
    if len(word) == 1 or word[0].islower():
        return True
    if s == i and c.isupper() and len(word) > 2 and word[1].isupper() and word[2].islower():
        return True
    return c.isupper() and before.islower()


@functools.lru_cache(maxsize=1)
def _suspects():
    """What can open a garbled span: telling characters, pairs without one, inner capitals."""
    import re

    long, single, _ = patterns()
    plain = SOUND | set(MARKS) | _NO_INK | _LIKE | {"?"}
    telling = frozenset({c for k in long for c in k[:2]} | {g for m in single.values() for g in m} | {LOST}) - plain
    pairs = sorted({k[:2] for k in long if telling.isdisjoint(k[:2])})
    caps = frozenset(c for c in LETTERS if c.isupper())
    small = "".join(c for c in LETTERS if c.islower())
    look = [rf"[a-z{small}][{''.join(sorted(caps))}]", rf"[A-Z][{small}][A-Z]", *map(re.escape, pairs)]
    return telling, caps | set(small) | {p[0] for p in pairs}, re.compile("|".join(look)), re.compile(r"\?[^\W\d_]")


def _suspicious(text: str) -> bool:
    """Quick look, so that sound texts skip the automaton."""
    telling, openers, look, lost = _suspects()
    if not telling.isdisjoint(text):
        return True
    if "?" in text and lost.search(text):
        return True
    return not openers.isdisjoint(text) and look.search(text) is not None


@functools.lru_cache(maxsize=1)
def _suspect_tables() -> tuple[np.ndarray, ...]:
    """``_suspects`` as tables over code points: telling, before a capital, accented capital,
    A to Z, accented small letter, first of a pair; and the pairs as sorted keys."""
    telling, _, _, _ = _suspects()
    small = [c for c in LETTERS if c.islower()]
    pairs = [k[:2] for k in patterns()[0] if telling.isdisjoint(k[:2])]
    table = lambda chars: C.one_of("".join(sorted(chars)))
    latin = [chr(x) for x in range(ord("A"), ord("Z") + 1)]
    keys = np.unique(np.array([(ord(k[0]) << 21) | ord(k[1]) for k in pairs], np.int64))
    return table(telling), table([c.lower() for c in latin] + small), table([c for c in LETTERS if c.isupper()]), table(latin), table(small), table([k[0] for k in pairs]), keys


def suspicious_rows(arr: pa.Array) -> np.ndarray:
    """The quick look over a whole batch at once: rows it leaves out hold no garbled span.

    Neighbours are compared across the ends of rows too, which may let a row too many in."""
    c, o = C.decode(arr)
    telling, before, caps, latin, small, first, keys = _suspect_tables()
    hit = telling[c]
    if len(c) > 2:
        hit[:-1] |= before[c[:-1]] & caps[c[1:]]
        hit[:-2] |= latin[c[:-2]] & small[c[1:-1]] & latin[c[2:]]
        hit[:-1] |= (c[:-1] == ord("?")) & C.alnum_table()[c[1:]]
        at = np.flatnonzero(first[c[:-1]])
        pair = (c[at].astype(np.int64) << 21) | c[at + 1]
        hit[at] |= keys[np.minimum(np.searchsorted(keys, pair), len(keys) - 1)] == pair
    n = np.concatenate([[0], np.cumsum(hit)])
    # a text of one or two characters is looked at by itself
    return (n[o[1:]] > n[o[:-1]]) | (np.diff(o) < 3) & (np.diff(o) > 0)


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """Garbled spans (start, end, original or '' where not known from the span alone)."""
    if not text or not _suspicious(text):
        return []
    out: list[tuple[int, int, str]] = []
    # leftmost, then longest of all matches
    found = sorted((end - len(k) + 1, -len(k), k, v) for end, (k, v) in automaton().iter(text))
    at = 0
    for s, _, k, v in found:
        if s < at:
            continue
        end = s + len(k) - 1
        at = end + 1
        if len(k) > 1:
            if _sound_pair(text, s, k):
                continue
            out.append((s, end + 1, v))
        elif _single_hit(text, s):
            out.append((s, end + 1, ""))
    taken = {i for s, e, _ in out for i in range(s, e)}
    more = {(i, i + 1, "") for i in _inner_capitals(text)} | set(_capital_words(text))
    return sorted(set(out) | {x for x in more if x[0] not in taken})


def _sound_pair(text: str, i: int, k: str) -> bool:
    """May the form ``k`` at ``i`` also be a sound letter and what follows it?  A look-alike
    capital and a mark, in a word of capitals; a letter of names and a scattered character
    without ink, where a word begins."""
    before = text[i - 1] if i else " "
    if k[0] in _LIKE and len(k) == 2 and not k[1].isalpha():
        return before.isupper()
    return k[-1] in _NO_INK and k[0] in _NAMES and not before.isalpha() and text[i + len(k) : i + len(k) + 1].islower()


@functools.lru_cache(maxsize=1)
def _inner():
    import regex

    caps = "".join(c for c in LETTERS if c.isupper())
    small = "".join(sorted({g for m in patterns()[1].values() for g in m if g.islower()} - _LIKE))
    return regex.compile(rf"(?<=\p{{Ll}})[{caps}](?=\p{{Ll}})|(?<=\p{{Ll}}\p{{Ll}})[{caps}]\b|(?<=\p{{Lu}})[{small}](?=\p{{Lu}}\p{{Lu}})|(?<=\p{{Lu}}\p{{Lu}})[{small}](?=\p{{Lu}})")


def _inner_capitals(text: str) -> list[int]:
    """Capitals with an accent after a small letter, and small letters amid capitals."""
    return [m.start() for m in _inner().finditer(text)]


def _capital_words(text: str) -> list[tuple[int, int, str]]:
    """Letters of no corpus language in words of capitals: a word is garbled if an encoding
    pair turns it into a known word; what the same pair explains beside it is garbled too,
    any other word of the kind is a name."""
    if text.isascii():
        return []
    known = _foreign()
    words: dict[str, list[int]] = {}
    for m in _capitals().finditer(text):
        if not known.isdisjoint(m.group()):
            words.setdefault(m.group(), []).append(m.start())
    if not words:
        return []
    backs = [{w: "".join(m.get(c, c) if c in known else c for c in w).lower() for w in words if all(c not in known or m.get(c, " ").isalpha() for c in w)} for m in patterns()[1].values()]
    sound = _known_words(sorted({x for back in backs for x in back.values()}))
    garbled = set().union(*[back for back in backs if not sound.isdisjoint(back.values())])
    return [(at + i, at + i + 1, "") for w in garbled for at in words[w] for i, c in enumerate(w) if c in known]


def _known_words(words: list[str]) -> set[str]:
    """Those of the words that stand in the vocabulary of the language model."""
    from . import languages

    c, o = C.unify(*C.decode(pa.array(words, pa.string())))
    s, e, woff = C.words(c, o)
    h = C.word_hashes(c, s, e)
    whole = np.diff(woff) == 1  # other words would be judged by a part of them
    ok = np.zeros(len(words), bool)
    ok[whole] = C.among(h[woff[:-1][whole]], languages.model()[0])
    return {w for w, x in zip(words, ok, strict=True) if x}


@functools.lru_cache(maxsize=1)
def _foreign() -> frozenset[str]:
    return frozenset(g for m in patterns()[1].values() for g in m if g.isupper() and g not in SOUND and g not in _LIKE)


@functools.lru_cache(maxsize=1)
def _capitals():
    import regex

    return regex.compile(r"\b\p{Lu}{2,}\b")


def _with_neighbours(text: str, found: list[tuple[int, int, str]], best: dict[str, str]) -> list[tuple[int, int, str]]:
    """The spans and, in lines that hold lone hits, the other characters of the same pair:
    letters that stand for letters, and marks between two letters."""
    taken = {i for s, e, _ in found for i in range(s, e)}
    letter = lambda j: 0 <= j < len(text) and (text[j].isalpha() or not text[j].isspace() and best.get(text[j], " ").isalpha())
    more, at = [], 0
    for line in text.splitlines(keepends=True):
        if any(not v and at <= s < at + len(line) for s, _, v in found):
            for i, c in enumerate(line, at):
                if i in taken or c not in best or c in "?" + LOST or not best[c].isalpha():
                    continue
                inside = letter(i - 1) and letter(i + 1)
                opens = c in "”€—–" and not letter(i - 1) and text[i + 1 : i + 2].islower()
                closes = c in "—–„‡†" and i and text[i - 1].isalpha() and text[i + 1 : i + 2] in (" ", ",", ".", "\n", "")
                if c.isalpha() or inside or opens or closes:
                    more.append((i, i + 1, ""))
        at += len(line)
    return sorted(found + more)


def restore(text: str | None) -> tuple[str | None, int, int]:
    """(restored text, garbled spans, spans that stay unrestored).

    Single characters take the original of the one encoding pair that explains most of
    the hits of the text; longer forms carry their original with them.
    """
    found = spans(text)
    if not found:
        return text, 0, 0
    lone = [text[s] for s, e, v in found if not v and text[s] not in "?" + LOST]
    best: dict[str, str] = {}
    if lone:
        best = max(patterns()[1].values(), key=lambda m: (sum(c in m and m[c] in SOUND for c in lone), sum(c in m and m[c] in FREQUENT for c in lone), sum(c in m for c in lone)))
    # where a longer form is open between encodings, the one that explains most of the text decides
    votes: dict[str, int] = {}
    for s, e, v in found:
        if v:
            for enc in patterns()[0][text[s:e]]:
                votes[enc] = votes.get(enc, 0) + 1
    ranked = sorted(votes, key=lambda enc: (-votes[enc], READ_AS.index(enc)))
    if best:
        found = _with_neighbours(text, found, best)
    out, at, left = [], 0, 0
    for s, e, v in found:
        if s < at:
            continue
        if v:
            options = patterns()[0][text[s:e]]
            v = next(options[enc] for enc in ranked if enc in options)
        v = v or best.get(text[s], "")
        left += not v
        out += [text[at:s], v or text[s:e]]
        at = e
    out.append(text[at:])
    back = "".join(out)
    if any(v for _, _, v in found):
        for k, v in patterns()[2].items():
            if k in back and (k[-1] in _NO_INK or all(c in SOUND for c in k)):
                back = back.replace(k, v)
    if any(len(v) for _, _, v in found) and back != text:
        again, n2, _ = restore(back) if len(back) < len(text) else (back, 0, 0)
        back = again if n2 else back
    return back, len(found), left


def restored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_garbled, n_left) of the affected records, text restored where possible."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        b = b.filter(pa.array(suspicious_rows(b.column(1))))
        rows = [(i, *restore(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows = [r for r in rows if r[2]]
        if not rows:
            return None
        i, t, n, left = zip(*rows, strict=True)
        return batch_of(id=pa.array(i, pa.int64()), text=pa.array(t, pa.string()), n=pa.array(n, pa.int32()), left=pa.array(left, pa.int32()))

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    out = map_text(src, "t", fn, "id long, text string, n int, left int")
    return out.select(F.col("id").alias(id_col), "text", F.col("n").alias("n_garbled"), F.col("left").alias("n_left"))


def garbled_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of every document with at least one garbled span; nothing is shuffled but ids."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        b = b.filter(pa.array(suspicious_rows(b.column(1))))
        hit = np.fromiter((bool(spans(t)) for t in b.column(1).to_pylist()), bool, b.num_rows)
        return batch_of(id=b.column(0).filter(pa.array(hit))) if hit.any() else None

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null and id is not null")
    return map_text(src, "t", fn, "id long").select(F.col("id").alias(id_col)).distinct()
