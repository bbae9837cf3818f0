"""Text functions as Column expressions (they stay inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the alphabet, with the six accented ones of Esperanto in both cases.
LETTERS = "A-Za-zĈĉĜĝĤĥĴĵŜŝŬŭ"
X_SYSTEM = {"cx": "ĉ", "gx": "ĝ", "hx": "ĥ", "jx": "ĵ", "sx": "ŝ", "ux": "ŭ", "Cx": "Ĉ", "Gx": "Ĝ", "Hx": "Ĥ", "Jx": "Ĵ", "Sx": "Ŝ", "Ux": "Ŭ"}
# Inflectional endings, longest first, with what they say.
ENDINGS = (("ojn", "noun", "pl", "acc"), ("ajn", "adj", "pl", "acc"), ("oj", "noun", "pl", "nom"), ("aj", "adj", "pl", "nom"), ("on", "noun", "sg", "acc"), ("an", "adj", "sg", "acc"), ("en", "adv", "sg", "acc"), ("as", "verb", "", ""), ("is", "verb", "", ""), ("os", "verb", "", ""), ("us", "verb", "", ""), ("o", "noun", "sg", "nom"), ("a", "adj", "sg", "nom"), ("e", "adv", "sg", "nom"), ("i", "verb", "", ""), ("u", "verb", "", ""))


def word_tokens(c: Column) -> Column:
    """Letter runs, digit runs and single other characters that are not blank."""
    return F.regexp_extract_all(c, F.lit(rf"[{LETTERS}]+|[0-9]+|[^\s{LETTERS}0-9]"), F.lit(0))


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[{LETTERS}]+"), F.lit(0))


def split_digits(tokens: Column) -> Column:
    """Numbers become single digits."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1)))).otherwise(F.array(t))))


def white_tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda t: t != "")


def boundary_join(words: Column) -> Column:
    """Words with a boundary mark between them."""
    return F.array_join(words, " <w> ")


def from_x_system(c: Column) -> Column:
    for a, b in X_SYSTEM.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ending(word: Column) -> Column:
    """The inflectional ending of a word whose stem keeps two letters or more, else ''."""
    e = None
    for text, *_ in ENDINGS:
        hit = word.endswith(text) & (F.length(word) >= len(text) + 2)
        e = F.when(hit, F.lit(text)) if e is None else e.when(hit, F.lit(text))
    return e.otherwise("")


def stem(word: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(ending(word)))


def pos_of(word: Column) -> Column:
    e, out = ending(word), None
    for text, pos, *_ in ENDINGS:
        out = F.when(e == text, F.lit(pos)) if out is None else out.when(e == text, F.lit(pos))
    return out.otherwise("other")


def accusative(phrase: Column) -> Column:
    """``n`` after every word of a phrase that inflects (ends in o, a, oj or aj; not the article)."""
    return F.array_join(F.transform(F.split(phrase, " "), lambda w: F.when(w.rlike("(o|a|oj|aj)$") & (w != "la"), F.concat(w, F.lit("n"))).otherwise(w)), " ")


def plural(word: Column) -> Column:
    return F.when(word.rlike("[oa]$"), F.concat(word, F.lit("j"))).otherwise(word)


def tense(verb: Column, end: str) -> Column:
    """Infinitive ending replaced by a tense ending."""
    return F.regexp_replace(verb, "i$", end)


def capitalise_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))


def sentences(c: Column) -> Column:
    """Parts after ``. ! ?`` and blanks; empty ones left out."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\S"))


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams as joined texts; none where there are fewer tokens."""
    k = F.size(tokens) - n + 1
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def repetition_rate(tokens: Column, n: int) -> Column:
    """1 - distinct / all n-grams; 0 for fewer than n + 1 tokens."""
    g = ngrams(tokens, n)
    return F.when(F.size(tokens) < n + 1, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g))


def foreign_rate(c: Column) -> Column:
    """Share of blank-separated words with a letter outside the alphabet."""
    w = white_tokens(c)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.filter(w, lambda x: x.rlike(rf"[\p{{L}}&&[^{LETTERS}]]"))) / F.size(w))


def length_excess(c: Column, free: int = 50, full: int = 150) -> Column:
    """0 up to ``free`` words, then linear to 1 at ``full``."""
    n = F.size(white_tokens(c))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n - free) / float(full - free)))


def demorph(c: Column) -> Column:
    """Readable text from morpheme tokens: control tokens and boundary marks become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("<w>"), F.lit(" ")), r"<\|[a-z_]+\|>|</?s>|<pad>|<unk>", " "), r"\s+", " "))


def numeric_answer(c: Column) -> Column:
    """The number after ``####``, else after the last key word, else the last number; null without one."""
    num = r"(-?[0-9]+(?:\.[0-9]+)?)"
    mark = F.nullif(F.regexp_extract(c, r"####\s*" + num, 1), F.lit(""))
    key = F.try_element_at(F.regexp_extract_all(F.lower(c), F.lit(r"(?:respondo estas|answer is|estas)\s*" + num), F.lit(1)), F.lit(-1))
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(num), F.lit(1)), F.lit(-1))
    return F.coalesce(mark, key, last).try_cast("double")


def closeness(a: Column, b: Column) -> Column:
    """1 for equal numbers, else exp(-min(relative error, 10)); null with a missing side."""
    rel = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9))
    return F.when(a == b, F.lit(1.0)).otherwise(F.exp(-F.least(rel, F.lit(10.0))))


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n.cast("double"), 0), F.lit(","), F.lit(" "))


def likely_english(c: Column, marks: tuple[str, ...] = (" the ", " of ", " and ", " in ", "university", "city", "list of")) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for m in marks:
        out = out | low.contains(m)
    return out


def broken_value(c: Column) -> Column:
    """Doubled last letter, or fewer than 2 or more than 80 characters."""
    n = F.length(c)
    doubled = (n >= 2) & (F.right(c, F.lit(1)) == F.substring(c, n - 1, F.lit(1))) & F.right(c, F.lit(1)).rlike(r"\p{L}")
    return (n < 2) | (n > 80) | doubled


NUMERALS = ("nul", "unu", "du", "tri", "kvar", "kvin", "ses", "sep", "ok", "naŭ")


def number_words(n: Column) -> Column:
    """0-999 in words; null outside."""
    units = F.array(*[F.lit(x) for x in NUMERALS])
    at = lambda k: F.get(units, k.cast("int"))
    h, t, u = F.floor(n / 100), F.floor((n % 100) / 10), n % 10
    big = lambda k, name: F.when(k == 0, F.lit(None)).when(k == 1, F.lit(name)).otherwise(F.concat(at(k), F.lit(name)))
    words = F.concat_ws(" ", big(h, "cent"), big(t, "dek"), F.when((u > 0), at(u)))
    return F.when((n < 0) | (n > 999), F.lit(None)).when(n == 0, F.lit("nul")).otherwise(words)


def nesting(c: Column, opening: str = "([{", closing: str = ")]}") -> Column:
    """struct(deepest, left): the greatest nesting of brackets, and how many stay open."""
    step = lambda acc, ch: F.struct(
        F.greatest(acc["deepest"], acc["left"] + F.when(ch.isin(*opening), 1).otherwise(0)).alias("deepest"),
        F.greatest(acc["left"] + F.when(ch.isin(*opening), 1).when(ch.isin(*closing), -1).otherwise(0), F.lit(0)).alias("left"),
    )
    # brackets are few, so everything else leaves before the fold
    marks = F.regexp_replace(c, r"[^()\[\]{}]", "")
    chars = F.when(F.length(marks) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(marks), F.lit(1))), lambda i: F.substring(marks, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.aggregate(chars, F.struct(F.lit(0).alias("deepest"), F.lit(0).alias("left")), step)


def agree(adjective: Column, plural: Column) -> Column:
    """The adjective in the number of its noun."""
    return F.concat(adjective, F.when(plural, "j").otherwise(""))

