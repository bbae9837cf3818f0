"""Language of documents and of their stretches, hierarchically.

First a family (constructed, Romance, Germanic, Slavic, or no language) is chosen by
one-versus-rest linear support vector machines, then a one-versus-one machine separates
the closely related languages inside it.  Features are words and letter trigrams; a
stretch's score is the mean over its words, so scores of words are computed once per
distinct word of a batch and added up for any stretch.

A text is cut at sentence ends and line breaks; short or doubtful stretches follow their
neighbour; stretches of one language that touch form a run.  A document holds a language
if a run of it has ``MIN_WORDS`` words or more.

Texts are judged after garbled spans are restored and look-alike characters unified, so
disguise does not change the language.

Defined results: null, empty and blank texts hold no language; texts that are not prose
(see ``prose``) hold none; no label is one of null, '', 'und', 'unknown', 'xx'; repeated
rows are judged alike and give one row per id and language; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from . import prose
from .batches import batch_of, map_text

MODEL = Path(__file__).with_name("models") / "languages.npz"
LANGUAGES = ("eo", "io", "fr", "es", "en", "de", "pl")
FAMILIES = (("eo", "io"), ("fr", "es"), ("en", "de"), ("pl",))  # the fifth class is no language
NONE = len(LANGUAGES)
MIN_WORDS = 8
#: Margins beyond this one count as this one in a confidence.
MOST_MARGIN = 3.0
#: A stretch of fewer words, or of a smaller margin, follows its neighbour.
SURE_WORDS, SURE_MARGIN = 4, 0.5
#: A stretch in the related other language of a document needs this margin.
PAIR_MARGIN = 0.7
BUCKETS = 1 << 13
U64 = np.uint64

# Three-letter codes of the languages.
ISO3 = {"epo": "eo", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "pol": "pl", "ido": "io"}
NO_LABEL = ("", "und", "unknown", "xx")


class Words:
    """Words, stretches and features of a batch of cleaned texts."""

    def __init__(self, c: np.ndarray, o: np.ndarray) -> None:
        low = C.lower_table()[c]
        s, e, _ = C.words(low, o)
        if len(s):  # addresses and assignments are no words of a language
            token = np.cumsum(C.one_of("\t\n ")[c] | C._row_starts(o, len(c)))
            odd = np.zeros(token[-1] + 1, bool)
            odd[token[C.one_of("/=@\\")[c]]] = True
            keep = ~odd[token[s]]
            s, e = s[keep], e[keep]
        woff = np.searchsorted(s, o)
        self.woff, self.n_rows = woff, len(o) - 1
        self.h = C.word_hashes(low, s, e)
        self.uniq, at, self.inv = np.unique(self.h, return_index=True, return_inverse=True)
        us, ue = s[at], e[at]
        # letter trigrams of each distinct word, its edges marked
        size = ue - us + 2
        word = np.repeat(np.arange(len(us)), size - 2)
        rank = np.arange(len(word)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
        padded = np.full(int(size.sum()), 1, np.uint64)
        begin = np.cumsum(size) - size
        if len(us):
            padded[begin[word] + 1 + rank] = low[us[word] + rank]
            with np.errstate(over="ignore"):
                g = C.mix(padded[:-2] * U64(0x1F123BB5) + padded[1:-1] * U64(0x9E3779B1) + padded[2:] * U64(0x85EBCA77)) if len(padded) > 2 else np.zeros(0, np.uint64)
            pos = begin[word] + rank
            self.tri, self.tri_word = (g[pos] % U64(BUCKETS)).astype(np.int64), word
        else:
            self.tri, self.tri_word = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tri_weight = 1.0 / np.sqrt(np.maximum(size - 2, 1))
        # stretches: cut after a sentence end or a line break
        cut = C.one_of(".!?…\n")[c]
        if len(c) > 1:  # a mark inside a word (a lost letter, a number) ends nothing
            letter = C.alnum_table()[c]
            inner = np.zeros(len(c), bool)
            inner[1:-1] = letter[:-2] & letter[2:]
            cut &= ~(inner & (c != 10))
        seg = np.concatenate([[0], np.cumsum(cut)])[s] if len(s) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(self.n_rows), np.diff(woff))
        new = np.ones(len(s), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (row[1:] != row[:-1])
        self.seg = np.cumsum(new) - 1
        self.seg_start = np.flatnonzero(new)
        self.seg_row = row[self.seg_start]
        self.seg_size = np.diff(np.append(self.seg_start, len(s)))
        self.char_start, self.char_end = s, e
        # names say nothing of the language: capital first, small after, not opening a stretch
        up = low != c
        self.name = np.zeros(len(s), bool)
        if len(s):
            self.name = up[s] & ~up[np.minimum(s + 1, e - 1)] & (e - s > 1)
            self.name[self.seg_start] = False
        # stretches with a letter that Ido does not write
        hat = np.concatenate([[0], np.cumsum(C.one_of("ĉĝĥĵŝŭ")[low])])
        self.hatted = np.bincount(self.seg, weights=(hat[e] > hat[s]) & ~self.name, minlength=len(self.seg_start)) > 0


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = np.load(MODEL, allow_pickle=False)
    return m["word"], m["word_weight"].astype(np.float64), m["tri_weight"].astype(np.float64), m["bias"].astype(np.float64)


@functools.lru_cache(maxsize=1)
def calibration() -> tuple[float, float]:
    """Slope and intercept that turn a margin into the chance of being right."""
    return tuple(np.load(MODEL, allow_pickle=False)["calibration"].tolist())


def word_scores(w: Words) -> np.ndarray:
    """(distinct words, 8): five family machines, then eo-io, fr-es, en-de."""
    word, ww, tw, _ = model()
    out = np.zeros((len(w.uniq), ww.shape[1]))
    p = np.searchsorted(word, w.uniq)
    p[p == len(word)] = 0
    known = word[p] == w.uniq
    out[known] += ww[p[known]]
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(w.tri_word, weights=tw[w.tri, k], minlength=len(w.uniq)) * w.tri_weight
    return out


def decide(mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index or NONE, margin) of mean scores."""
    fam = mean[:, :5]
    order = np.argsort(fam, axis=1)
    best = order[:, -1]
    margin = fam[np.arange(len(fam)), best] - fam[np.arange(len(fam)), order[:, -2]] if len(fam) else np.zeros(0)
    lang = np.full(len(mean), NONE)
    for k in range(3):
        pick = best == k
        lang[pick] = 2 * k + (mean[pick, 5 + k] < 0)
        margin[pick] = np.minimum(margin[pick], np.abs(mean[pick, 5 + k]))
    lang[best == 3] = 6
    return lang, margin


def stretches(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one language: (row, language, words, confidence) plus their first word."""
    if not len(w.h):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0), z
    _, _, _, bias = model()
    sc = word_scores(w)[w.inv]
    sc[w.name] = 0.0
    acc = np.add.reduceat(sc, w.seg_start, axis=0)
    mean = acc / w.seg_size[:, None] + bias
    lang, margin = decide(mean)
    weak = (w.seg_size < SURE_WORDS) | (margin < SURE_MARGIN)
    first = np.ones(len(lang), bool)
    first[1:] = w.seg_row[1:] != w.seg_row[:-1]
    # doubtful stretches take the language of the last sure one before, else of the next
    idx = np.where(~weak, np.arange(len(lang)), -1)
    prev = np.maximum.accumulate(idx)
    ok_prev = (prev >= 0) & (w.seg_row[np.maximum(prev, 0)] == w.seg_row)
    nxt_idx = np.where(~weak, np.arange(len(lang)), len(lang))
    nxt = np.minimum.accumulate(nxt_idx[::-1])[::-1]
    ok_next = (nxt < len(lang)) & (w.seg_row[np.minimum(nxt, len(lang) - 1)] == w.seg_row)
    lang = np.where(weak & ok_prev, lang[np.maximum(prev, 0)], np.where(weak & ok_next, lang[np.minimum(nxt, len(lang) - 1)], lang))
    lang = _pairs_settled(w, lang, mean)
    new = first.copy()
    new[1:] |= lang[1:] != lang[:-1]
    start = np.flatnonzero(new)
    size = np.add.reduceat(w.seg_size, start)
    conf = np.add.reduceat(np.minimum(margin, MOST_MARGIN) * w.seg_size, start) / size
    slope, intercept = calibration()
    return w.seg_row[start], lang[start], size, 1 / (1 + np.exp(-(slope * conf + intercept))), w.seg_start[start]


def _pairs_settled(w: Words, lang: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A doubtful stretch of the closely related other language of a document goes to the
    one that most of the document is in (the two differ in few words).  Doubt is of the
    pair alone: a stretch stands if its own margin in the machine of the pair reaches
    ``PAIR_MARGIN``, or that of the run of its language it is part of, however few its words.
    Words with a letter that Ido does not write leave no margin for Ido."""
    pair = np.minimum(lang // 2, 2)
    own = np.where(lang % 2 == 0, 1.0, -1.0) * mean[np.arange(len(lang)), 5 + pair]
    own = np.where((lang == 1) & w.hatted, np.minimum(own, 0.0), own)
    new = np.ones(len(lang), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (w.seg_row[1:] != w.seg_row[:-1])
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    whole = np.add.reduceat(own * w.seg_size, start) / np.add.reduceat(w.seg_size, start)
    size = np.zeros((w.n_rows, NONE + 1))
    np.add.at(size, (w.seg_row, lang), w.seg_size)
    other = np.array([1, 0, 3, 2, 5, 4, 6, 7])[lang]
    minor = (size[w.seg_row, other] > size[w.seg_row, lang]) & (other != lang)
    weak = (own < PAIR_MARGIN) & (whole[run] < PAIR_MARGIN)
    return np.where(minor & weak, other, lang)


def held(c: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, language, confidence) of every language a row holds."""
    row, lang, size, conf, _ = stretches(Words(c, o))
    ok = (lang != NONE) & (size >= MIN_WORDS)
    row, lang, conf, size = row[ok], lang[ok], conf[ok], size[ok]
    key = row * 16 + lang
    u, inv = np.unique(key, return_inverse=True)
    total = np.bincount(inv, weights=size, minlength=len(u))
    mean = np.bincount(inv, weights=conf * size, minlength=len(u)) / np.maximum(total, 1)
    return u // 16, u % 16, mean


def label_code(label: Column) -> Column:
    """Two-letter code a label names, null for no label; script suffixes are dropped."""
    base = F.lower(F.trim(F.regexp_extract(F.trim(label.cast("string")), r"^([A-Za-z]+)", 1)))
    full = F.lower(F.trim(label.cast("string")))
    codes = F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])
    code = F.coalesce(F.try_element_at(codes, base), base)
    return F.when(label.isNull() | full.isin(*NO_LABEL), F.lit(None).cast("string")).otherwise(code)


def document_languages(df: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, label, lang, confidence, n_held): a row per language a document holds."""
    fw = prose.function_words(common)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        c, o = prose.clean(b.column(1))
        total, good = prose.judged(prose.Lines(c, o, fw))
        row, lang, conf = held(c, o)
        ok = good[row] * 2 >= total[row]
        row, lang, conf = row[ok], lang[ok], conf[ok]
        if not len(row):
            return None
        n = np.bincount(row, minlength=b.num_rows)
        at = pa.array(row)
        return batch_of(id=b.column(0).take(at), label=b.column(2).take(at), lang=pa.array([LANGUAGES[k] for k in lang], pa.string()), confidence=conf, n_held=n[row].astype(np.int32))

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), label_code(F.col(label_col)).alias("label"))
    src = src.where("t is not null and id is not null")
    return map_text(src, "t", fn, "id long, label string, lang string, confidence double, n_held int").withColumnRenamed("id", id_col)


def mislabelled(df: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, lang) of documents whose label is not exactly the one language they hold."""
    d = document_languages(df, common, id_col, text_col, label_col)
    return d.where("n_held > 1 or label is null or label <> lang").select(id_col, "lang").distinct()


def segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seq, lang, n_words, confidence): every run of one language, in text order."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        row, lang, size, conf, _ = stretches(Words(*prose.clean(b.column(1))))
        if not len(row):
            return None
        seq = np.arange(len(row)) - np.searchsorted(row, row)
        names = [*LANGUAGES, None]
        return batch_of(id=b.column(0).take(pa.array(row)), seq=seq.astype(np.int32), lang=pa.array([names[k] for k in lang], pa.string()), n=size.astype(np.int32), conf=conf)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null and id is not null")
    out = map_text(src, "t", fn, "id long, seq int, lang string, n int, conf double")
    return out.select(F.col("id").alias(id_col), "seq", "lang", F.col("n").alias("n_words"), F.col("conf").alias("confidence"))
