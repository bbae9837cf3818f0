"""Rule-based grammar checks and claim extraction for Esperanto texts.

One Arrow function parses a text once and runs every check on the parse; queries explode
the resulting arrays.  The checks are plain functions in ``CHECKS``, so more can be added.

Defined results: null and blank texts have no diagnostics and no claims.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parallel import spread
from .morphology import CORRELATIVES, PARTICLES, PRONOUNS, Dictionary, decompose, known_stem, split_ending

WORD = re.compile(r"[A-Za-zĈĉĜĝĤĥĴĵŜŝŬŭ]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")
PREPOSITIONS = frozenset("al de da el en ĝis inter je kun per po por post preter pri pro sen sub super sur tra trans apud ĉe dum ekster krom antaŭ ĉirkaŭ kontraŭ laŭ malantaŭ malgraŭ anstataŭ".split())
DIRECTIONAL = frozenset("en sur sub super tra trans inter antaŭ apud ĉirkaŭ kontraŭ post ekster preter malantaŭ".split())
COPULAS = frozenset("est far iĝ ŝajn rest".split())
# Common verbs by whether they take an object.
TRANSITIVE = frozenset("aĉet aŭd bat bezon elekt far ferm frap gard hav ĵet kaŝ kolekt konstru kovr kuir lav leg lig malferm manĝ memor mezur montr port pren prunt puŝ ripar romp send serĉ skrib ŝanĝ ŝarĝ ŝat ŝlos tranĉ trov uz vend vid".split())
INTRANSITIVE = frozenset("aper alven atend bril danc dorm fal flos flug glit ir kresk kur kuŝ marŝ naĝ parol plor respond rest rid ripoz sid silent star ŝveb trem ven venk velk vojaĝ".split())


@dataclass
class Token:
    text: str
    start: int
    end: int
    pos: str
    stem: str
    plural: bool = False
    accusative: bool = False
    comma: bool = False


def analyse(text: str, base: int = 0) -> list[Token]:
    out = []
    for m in WORD.finditer(text):
        w = m.group().lower()
        comma = text[m.end() : m.end() + 1] in (",", ";", ":")
        if w == "la":
            pos, stem, pl, acc = "article", w, False, False
        elif w in PREPOSITIONS:
            pos, stem, pl, acc = "prep", w, False, False
        elif w in PRONOUNS or w[:-1] in PRONOUNS and w.endswith("n"):
            pos, stem, pl, acc = "pronoun", w.removesuffix("n") if w not in PRONOUNS else w, w.startswith(("ni", "vi", "ili")), w not in PRONOUNS
        elif w in PARTICLES or w.rstrip("jn") in CORRELATIVES or w in CORRELATIVES:
            pos, stem, pl, acc = "particle", w, False, False
        else:
            stem, e = split_ending(w)
            pos = {"o": "noun", "a": "adj", "e": "adv"}.get(e[:1], "") if e else ""
            pos = "verb" if e in ("as", "is", "os", "us", "i", "u") else pos or "other"
            pl, acc = "j" in e, e.endswith("n") and pos in ("noun", "adj", "adv")
        out.append(Token(w, base + m.start(), base + m.end(), pos, stem, pl, acc, comma))
    return out


Diagnostic = tuple[str, int, int, str]

# Words that open clauses and words that join like parts.
SUBORDINATORS = frozenset("ke ĉar kiam se dum kvankam ĝis ol kvazaŭ por kie kial kiel".split())
RELATIVES = frozenset("kiu kio kies kia".split())
COORDINATORS = frozenset("kaj aŭ sed nek do tial".split())


def finite(t: Token) -> bool:
    return t.pos == "verb" and t.text.endswith(("as", "is", "os", "us", "u"))


def noun_phrases(ts: list[Token]) -> list[tuple[int, int]]:
    """(first, head) of every noun phrase: from the noun to the left over its adjectives, numbers,
    determiners and article, and the adverbs of its adjectives; a comma, an article or any
    other word ends it."""
    out = []
    for head, t in enumerate(ts):
        if t.pos not in ("noun", "pronoun"):
            continue
        first = j = head
        while t.pos == "noun" and j > 0:
            b = ts[j - 1]
            if b.comma and b.pos != "adj":
                break
            if b.pos == "article":
                first = j - 1
                break
            determiner = b.pos == "particle" and b.text.rstrip("jn") in CORRELATIVES and b.text.rstrip("jn")[-1] in "ua"
            if b.pos == "adj" or determiner:
                first = j = j - 1
            elif b.pos in ("adv", "particle") and ts[j].pos == "adj" and b.text not in COORDINATORS and b.text not in SUBORDINATORS:
                first = j = j - 1
            else:
                break
        out.append((first, head))
    return out


def in_prepositional(ts: list[Token]) -> set[int]:
    """Heads of noun phrases that stand behind a preposition, coordinated ones included."""
    phrases = noun_phrases(ts)
    inside: set[int] = set()
    for k, (first, head) in enumerate(phrases):
        before = ts[first - 1] if first else None
        if before is not None and before.pos == "prep":
            inside.add(head)
        elif before is not None and before.text in ("kaj", "aŭ") and k and phrases[k - 1][1] == first - 2 and phrases[k - 1][1] in inside:
            # joined to a phrase of the same case, with no verb of its own behind it
            after = next((x for x in ts[head + 1 :] if x.pos != "adv"), None)
            if ts[phrases[k - 1][1]].accusative == ts[head].accusative and not (after is not None and finite(after)):
                inside.add(head)
    return inside


def clauses(ts: list[Token]) -> list[tuple[int, int]]:
    """(begin, end) of the clauses of a sentence.

    A subordinator or a relative word after a comma opens a clause; a coordinator or a comma
    does where a finite verb stands on both sides of it.  What holds no finite verb belongs
    to the clause before it."""
    verbs = [0]
    for t in ts:
        verbs.append(verbs[-1] + finite(t))
    stops = [len(ts)] * (len(ts) + 1)  # where the next clause word stands
    for i in range(len(ts) - 1, -1, -1):
        stops[i] = i if ts[i].text in SUBORDINATORS or ts[i].text in RELATIVES else stops[i + 1]
    cuts = [0]
    for i, t in enumerate(ts):
        if not i:
            continue
        comma = ts[i - 1].comma
        verb_before = verbs[i] > verbs[cuts[-1]]
        verb_after = verbs[stops[i + 1]] > verbs[i]
        if t.text in SUBORDINATORS and t.text not in ("dum", "ĝis", "por", "ol"):
            cuts.append(i)
        elif t.text in ("dum", "ĝis", "ol") and verb_before and verb_after:
            cuts.append(i)
        elif t.text == "por" and ts[i + 1 : i + 2] and ts[i + 1].text == "ke":
            cuts.append(i)
        elif t.text.rstrip("jn") in RELATIVES and comma:
            cuts.append(i)
        elif (t.text in COORDINATORS or comma) and verb_before and verb_after:
            cuts.append(i)
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, [*cuts[1:], len(ts)], strict=True):
        if out and verbs[b] == verbs[a] and ts[a].text not in SUBORDINATORS:
            out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out


def transitive(stem: str, verbs: dict[str, bool] | None = None) -> bool | None:
    """Does a verb take an object?  The suffixes -ig and -iĝ settle it, then the table of
    ``verbs`` (a dictionary's), then the common verbs; a prefix changes nothing; None: unknown."""
    if stem.endswith("ig") and len(stem) > 3:
        return True
    if stem.endswith("iĝ") and len(stem) > 3:
        return False
    if verbs and stem in verbs:
        return verbs[stem]
    if stem in TRANSITIVE:
        return True
    if stem in INTRANSITIVE:
        return False
    rest = next((stem[len(p) :] for p in ("mal", "dis", "mis", "re", "ek") if stem.startswith(p) and len(stem) > len(p) + 2), None)
    return transitive(rest, verbs) if rest else None


def np_agreement(ts: list[Token]) -> list[Diagnostic]:
    """Adjectives directly before a noun agree with it in number and case."""
    out = []
    for i, t in enumerate(ts):
        j = i - 1
        while t.pos == "noun" and j >= 0 and ts[j].pos == "adj" and not ts[j].comma:
            if (ts[j].plural, ts[j].accusative) != (t.plural, t.accusative):
                out.append(("np_agreement", ts[j].start, t.end, f"{ts[j].text} {t.text}"))
            j -= 1
    return out


def predicate_agreement(ts: list[Token]) -> list[Diagnostic]:
    """An adjective after a copula agrees in number with the subject noun before it, and has no accusative."""
    out = []
    for i, t in enumerate(ts):
        if t.pos == "verb" and t.stem == "est":
            subject = next((x for x in reversed(ts[:i]) if x.pos in ("noun", "pronoun") and not x.accusative), None)
            pred = next((x for x in ts[i + 1 : i + 4] if x.pos == "adj"), None)
            k = ts.index(pred) if pred else 0
            alone = pred and not (k + 1 < len(ts) and ts[k + 1].pos == "noun")
            if subject and alone and (pred.plural != subject.plural or pred.accusative) and subject.pos == "noun":
                out.append(("predicate_agreement", subject.start, pred.end, f"{subject.text} … {pred.text}"))
    return out


def participle_agreement(ts: list[Token]) -> list[Diagnostic]:
    out = []
    for a, b in zip(ts, ts[1:], strict=False):
        if a.pos == "noun" and b.pos == "adj" and b.stem.endswith(("ant", "int", "ont", "at", "it", "ot")) and not a.comma and a.plural != b.plural:
            out.append(("participle_agreement", a.start, b.end, f"{a.text} {b.text}"))
    return out


def _object(ts: list[Token], i: int, inside: set[int]) -> Token | None:
    """The noun that follows a verb as its object; what stands behind a preposition (``inside``) is none."""
    j = i + 1
    while j < len(ts):
        t = ts[j]
        if t.comma and t.pos not in ("noun", "pronoun") or t.pos == "verb" or t.text in ("kaj", "ke", "sed", "ĉar", "kiam", "se", "dum", "ol"):
            return None
        if t.pos in ("noun", "pronoun") and j not in inside:
            return t
        j += 1
    return None


def missing_accusative(ts: list[Token]) -> list[Diagnostic]:
    out, inside, subject = [], None, False
    for i, t in enumerate(ts):
        if t.pos == "verb" and subject and transitive(t.stem):
            inside = in_prepositional(ts) if inside is None else inside
            o = _object(ts, i, inside)
            if o is not None and not o.accusative:
                out.append(("missing_accusative", t.start, o.end, f"{t.text} … {o.text}"))
        subject = subject or t.pos in ("noun", "pronoun") and not t.accusative
    return out


def intransitive_accusative(ts: list[Token]) -> list[Diagnostic]:
    out, inside = [], None
    for i, t in enumerate(ts):
        if t.pos == "verb" and transitive(t.stem) is False:
            inside = in_prepositional(ts) if inside is None else inside
            o = _object(ts, i, inside)
            if o is not None and o.accusative:
                out.append(("intransitive_accusative", t.start, o.end, f"{t.text} … {o.text}"))
    return out


def preposition_case(ts: list[Token]) -> list[Diagnostic]:
    out = []
    for i, t in enumerate(ts):
        if t.pos == "prep" and t.text not in DIRECTIONAL:
            o = next((x for x in ts[i + 1 : i + 4] if x.pos in ("noun", "pronoun")), None)
            if o is not None and o.accusative and all(x.pos in ("article", "adj", "particle") for x in ts[i + 1 : ts.index(o)]):
                out.append(("preposition_case", t.start, o.end, f"{t.text} … {o.text}"))
    return out


def wrong_endings(ts: list[Token]) -> list[Diagnostic]:
    """Two nouns side by side in one case, or an adjective directly before a verb and after an article."""
    out = []
    for a, b in zip(ts, ts[1:], strict=False):
        if a.pos == "noun" and b.pos == "noun" and not a.comma and a.accusative == b.accusative and a.text[0:1] != a.text[0:1].upper():
            out.append(("noun_noun", a.start, b.end, f"{a.text} {b.text}"))
    for a, b, c in zip(ts, ts[1:], ts[2:], strict=False):
        if a.pos == "article" and b.pos == "adj" and c.pos == "verb" and c.stem not in COPULAS:
            out.append(("adjective_verb", b.start, c.end, f"{b.text} {c.text}"))
    return out


def tautology(ts: list[Token]) -> list[Diagnostic]:
    out = []
    for a, b, c in zip(ts, ts[1:], ts[2:], strict=False):
        if a.pos == c.pos == "noun" and b.text in ("de", "da", "kaj", "aŭ") and a.stem == c.stem:
            out.append(("tautology", a.start, c.end, f"{a.text} {b.text} {c.text}"))
    return out


def affix_compat(ts: list[Token]) -> list[Diagnostic]:
    """Verb-making suffixes side by side, or a person suffix on a place suffix."""
    out = []
    for t in ts:
        parts = decompose(t.text)
        for a, b in zip(parts, parts[1:], strict=False):
            if (a, b) in (("ig", "iĝ"), ("iĝ", "ig"), ("ec", "ec"), ("ej", "ist"), ("in", "in")):
                out.append(("affix_compat", t.start, t.end, t.text))
    return out


#: Checks that look at a whole sentence; the others are run on each clause.
WHOLE = frozenset({np_agreement, affix_compat})
CHECKS = {"np": np_agreement, "predicate": predicate_agreement, "participle": participle_agreement, "accusative": missing_accusative, "intransitive": intransitive_accusative, "preposition": preposition_case, "endings": wrong_endings, "tautology": tautology, "affix": affix_compat}


def lexicon_check(d: Dictionary):
    """A check that reports content words whose stem the dictionary does not explain."""

    def check(ts: list[Token]) -> list[Diagnostic]:
        return [("unknown_stem", t.start, t.end, t.text) for t in ts if t.pos in ("noun", "adj", "verb", "adv") and not known_stem(t.text, d)]

    return check


def claims(ts: list[Token]) -> list[tuple[str, str, str, float]]:
    """(subject, relation, object, confidence) of one sentence."""
    out = []
    for i, t in enumerate(ts):
        if t.pos != "verb" or t.text.endswith(("i", "u")):
            continue
        subj = next((x for x in reversed(ts[:i]) if x.pos in ("noun", "pronoun") and not x.accusative), None)
        if subj is None:
            continue
        k = ts.index(subj)
        if k and any(x.pos == "prep" for x in ts[max(0, k - 3) : k]):
            head = next((x for x in reversed(ts[:k]) if x.pos == "noun" and not x.accusative), None)
            subj = head or subj
        if t.stem in COPULAS:
            pred = next((x for x in ts[i + 1 :] if x.pos in ("noun", "adj")), None)
            if pred:
                out.append((subj.stem, "est", pred.stem, 0.9 if t.stem == "est" else 0.6))
            continue
        obj = next((x for x in ts[i + 1 :] if x.pos in ("noun", "pronoun") and x.accusative), None)
        if obj:
            out.append((subj.stem, t.stem, obj.stem, 0.8))
        elif not any(x.pos == "prep" for x in ts[i + 1 :]):
            out.append((subj.stem, t.stem, "", 0.4))
        for j, p in enumerate(ts[i + 1 :], i + 1):
            if p.pos == "prep":
                o = next((x for x in ts[j + 1 : j + 5] if x.pos == "noun"), None)
                if o:
                    out.append((subj.stem, f"{t.stem}_{p.text}", o.stem, 0.6))
    return list(dict.fromkeys(out))


def phrases(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence, clause, kind, text): noun phrases of every clause, ``pp`` behind a preposition, else ``np``."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b[id_col], b[text_col], strict=True):
                for n, m in enumerate(SENTENCE.finditer(text or "")):
                    ts = analyse(m.group())
                    for k, (lo, hi) in enumerate(clauses(ts)):
                        part = ts[lo:hi]
                        inside = in_prepositional(part)
                        rows += [(i, n, k, "pp" if head in inside else "np", " ".join(t.text for t in part[first : head + 1])) for first, head in noun_phrases(part)]
            yield pd.DataFrame(rows, columns=[id_col, "sentence", "clause", "kind", "text"])

    return spread(df.select(id_col, text_col)).mapInPandas(run, f"{id_col} {kind}, sentence int, clause int, kind string, text string")


RESULT = "n_sentences int, n_clean int, diagnostics array<struct<check:string,start:int,end:int,text:string>>, claims array<struct<subject:string,relation:string,object:string,confidence:double>>"


def verified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", checks: tuple[str, ...] = tuple(CHECKS), d: Dictionary | None = None) -> DataFrame:
    """(id, n_sentences, n_clean, diagnostics, claims): one parse per text for all checks.

    ``n_clean`` counts sentences with a claim and no diagnostic (the parseable rate).
    """
    kind = dict(df.dtypes)[id_col]
    run_checks = [CHECKS[c] for c in checks] + ([lexicon_check(d)] if d else [])

    def one(text):
        diags, found, n, clean = [], [], 0, 0
        for m in SENTENCE.finditer(text or ""):
            ts = analyse(m.group(), m.start())
            if not ts:
                continue
            n += 1
            parts = [ts[a:b] for a, b in clauses(ts)]
            bad = [x for c in run_checks for p in ([ts] if c in WHOLE else parts) for x in c(p)]
            got = [x for p in parts for x in claims(p)]
            clean += bool(got) and not bad
            diags += bad
            found += got
        return n, clean, diags, found

    def run(batches):
        for b in batches:
            rows = [one(t) for t in b[text_col]]
            yield pd.DataFrame({id_col: b[id_col], "n_sentences": [r[0] for r in rows], "n_clean": [r[1] for r in rows], "diagnostics": [[dict(zip(("check", "start", "end", "text"), x, strict=True)) for x in r[2]] for r in rows], "claims": [[dict(zip(("subject", "relation", "object", "confidence"), x, strict=True)) for x in r[3]] for r in rows]})

    return spread(df.select(id_col, text_col)).mapInPandas(run, f"{id_col} {kind}, {RESULT}")


def claim_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n, shared): claims of ``a`` that ``b`` holds too; copula claims match both ways."""
    flat = lambda x: x.select(key, F.explode("claims").alias("c")).select(key, "c.subject", "c.relation", "c.object").distinct()
    x, y = flat(a), flat(b)
    back = y.where("relation = 'est'").select(key, F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    hit = y.unionByName(back).distinct().withColumn("hit", F.lit(1))
    return x.join(hit, [key, "subject", "relation", "object"], "left").groupBy(key).agg(F.count("*").alias("n"), F.count("hit").alias("shared"))
