"""Per-document text statistics, and prose or not by nearest structural profile.

Every line of a text gives five small distributions: character classes, word classes
(with the share of common function words), how the line begins, how it ends and how many
words it has.  They are compared with stored profiles of language prose (plain, wrapped,
verse, dialogue) and of other structures (lists, tables, logs, code, links, keywords,
noise) by Jensen-Shannon divergence; the line takes the kind of its nearest profile.  A
document is prose if at least half of its ink stands in lines of prose.

The profiles are fitted by ``train.py`` and stored beside the code; their number and size
are fixed.  Basic counts (words, mean word length, shares) come out of the same pass.

Defined results: null, empty and blank texts have null statistics and are no case; lines
without ink are skipped; texts of one line are judged like others; repeated rows give a
row each in ``text_statistics``; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from . import garble
from .batches import batch_of, map_text

MODEL = Path(__file__).with_name("models") / "profiles.npz"
CHAR, WORD, HEAD, TAIL, COUNT = 9, 6, 6, 6, 6
GROUPS = np.cumsum([0, CHAR, WORD, HEAD, TAIL, COUNT])
GROUP_WEIGHT = np.array([1.0, 1.5, 0.7, 0.7, 0.9])
#: So many words in a line without a common word are never prose.
BARE_WORDS = 12
#: Most function words the statistics accept (the table is collected to the driver).
MAX_FUNCTION_WORDS = 50_000


@functools.lru_cache(maxsize=1)
def char_class() -> np.ndarray:
    """0 letter, 1 digit, 2 blank, 3 sentence end, 4 comma, 5 quote or dash, 6 bracket,
    7 delimiter, 8 anything else."""
    t = np.full(C.N_CP, 8, np.uint8)
    t[C.alnum_table()] = 0
    for k, s in ((1, "0123456789"), (2, " \t"), (3, ".!?…"), (4, ","), (5, "“”„‚‘’'\"«»–—-"), (6, "()[]{}<>"), (7, "|=/_&#@%*+~^$\\;:")):
        t[[ord(c) for c in s]] = k
    return t


def clean(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, garbled spans restored, in the one consistent form."""
    arr = arr.cast(pa.string())
    some = garble.suspicious_rows(arr)
    if some.any():
        fixed = [garble.restore(t)[0] if t and not t.isascii() else t for t in arr.filter(pa.array(some)).to_pylist()]
        arr = pa.compute.replace_with_mask(arr, pa.array(some), pa.array(fixed, pa.string()))
    return C.unify(*C.decode(arr))


class Lines:
    """Lines with ink of a batch: flat arrays over all rows."""

    def __init__(self, c: np.ndarray, o: np.ndarray, function_words: np.ndarray) -> None:
        n = len(c)
        cls = char_class()[c]
        first = C._row_starts(o, n) if n else np.zeros(0, bool)
        nl = c == 10
        begin = first.copy()
        if n:
            begin[1:] |= nl[:-1]
        line = np.cumsum(begin) - 1  # line of each character
        n_lines = int(line[-1]) + 1 if n else 0
        starts = np.flatnonzero(begin)
        row = np.searchsorted(o, starts, side="right") - 1
        body = ~nl
        ink = body & (cls != 2)
        chars = np.bincount(line[body] * CHAR + cls[body], minlength=n_lines * CHAR).reshape(n_lines, CHAR).astype(np.float64)
        self.ink = np.bincount(line[ink], minlength=n_lines).astype(np.float64)
        # words
        low = C.lower_table()[c] if n else c
        s, e, woff = C.words(low, o)
        self.h = C.word_hashes(low, s, e)
        self.s, self.e, self.woff = s, e, woff
        wl = line[s] if len(s) else np.zeros(0, np.int64)
        size = e - s
        digits = np.concatenate([[0], np.cumsum(cls == 1)])
        letters = np.concatenate([[0], np.cumsum(cls == 0)])
        nd, na = digits[e] - digits[s], letters[e] - letters[s]
        common = C.among(self.h, function_words)
        upper = low != c
        ups = np.concatenate([[0], np.cumsum(upper)])
        nu = ups[e] - ups[s]
        kind = np.full(len(s), 1)  # 0 common, 1 other small or all capitals, 2 capital first, 3 number, 4 mixed, 5 odd
        cap = (nu > 0) & (nu < size) if len(s) else np.zeros(0, bool)
        kind[cap] = 2
        kind[common] = 0
        kind[(nd > 0) & (na > 0)] = 4
        kind[(nd > 0) & (na == 0)] = 3
        vowel = C.one_of("aeiouy")[C.base_table()[c]] if n else np.zeros(0, bool)
        vs = np.concatenate([[0], np.cumsum(vowel)])
        nv = vs[e] - vs[s]
        kind[((size > 24) | ((nd == 0) & (size > 3) & (nv * 6 < size))) & (kind != 0)] = 5
        words = np.bincount(wl * WORD + kind, minlength=n_lines * WORD).reshape(n_lines, WORD).astype(np.float64)
        self.words, self.line_of_word = words.sum(1), wl
        # first and last ink
        idx = np.arange(n)
        first_ink = np.full(n_lines, n, np.int64)
        np.minimum.at(first_ink, line[ink], idx[ink])
        last_ink = np.full(n_lines, -1, np.int64)
        np.maximum.at(last_ink, line[ink], idx[ink])
        some = self.ink > 0
        head = np.zeros((n_lines, HEAD))
        tail = np.zeros((n_lines, TAIL))
        count = np.zeros((n_lines, COUNT))
        f, la = first_ink[some], last_ink[some]
        alnum = np.flatnonzero((cls == 0) | (cls == 1))
        nxt = np.searchsorted(alnum, f)
        at = np.where(nxt < len(alnum), alnum[np.minimum(nxt, max(len(alnum) - 1, 0))] if len(alnum) else n, n)
        inside = np.zeros(len(f), bool)
        if len(alnum):
            inside = (at < n) & (line[np.minimum(at, n - 1)] == line[f])
        at = np.where(inside, at, f)
        bullet = (at > f) & (cls[f] != 5) | (at > f) & C.one_of("-–—")[c[f]]
        # 0 capital, 1 small, 2 digit, 3 bullet then capital, 4 bullet then small, 5 other
        hk = np.where(cls[at] == 1, 2, np.where(cls[at] != 0, 5, np.where(upper[at], np.where(bullet, 3, 0), np.where(bullet, 4, 1))))
        head[np.flatnonzero(some), hk] = 1
        lc = cls[la]
        # a closing quote looks at the mark before it
        prev = np.maximum(la - 1, 0)
        lc = np.where((lc == 5) & (cls[prev] == 3), 3, lc)
        # 0 sentence end, 1 comma or semicolon, 2 letter, 3 digit, 4 bracket, 5 other
        tk = np.select([lc == 3, (lc == 4) | C.one_of(":;")[c[la]], lc == 0, lc == 1, lc == 6], [0, 1, 2, 3, 4], 5)
        tail[np.flatnonzero(some), tk] = 1
        ck = np.digitize(self.words, [1, 3, 5, 8, 15])
        count[np.arange(n_lines), ck] = 1
        unit = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1e-12)
        self.x = np.concatenate([unit(chars), unit(words), head, tail, count], axis=1)[some]
        self.row, self.weight = row[some], self.ink[some]
        self.head, self.tail, self.n_words = hk, tk, self.words[some]
        self.common = words[some, 0]
        self.start = starts[some]
        self.chars, self.kinds = chars[some], words[some]
        self.index = np.full(n_lines, -1)
        self.index[some] = np.arange(int(some.sum()))
        self.n_rows = len(o) - 1


def _entropy(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.where(p > 0, p * np.log2(p), 0.0)


def divergence(x: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """(lines, profiles) weighted sum of the five Jensen-Shannon divergences."""
    out = np.empty((len(x), len(profiles)), np.float32)
    weight = np.repeat(GROUP_WEIGHT, np.diff(GROUPS))
    hx, hp = (_entropy(x) * weight).sum(1), (_entropy(profiles) * weight).sum(1)
    for j, p in enumerate(profiles):
        out[:, j] = (_entropy((x + p) / 2) * weight).sum(1) - (hx + hp[j]) / 2
    return out


#: Profiles whose divergence is worked out for every line: the nearest in Hellinger distance.
SHORT_LIST = 6


def nearest(x: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Index of the nearest profile of each line.

    The Jensen-Shannon divergence (in bits) is at least the squared Hellinger distance;
    profiles outside the short list that this bound does not prove farther are worked out too.
    """
    if len(profiles) <= SHORT_LIST:
        return divergence(x, profiles).argmin(1)
    weight = np.sqrt(np.repeat(GROUP_WEIGHT, np.diff(GROUPS)))
    a, b = np.sqrt(x) * weight, np.sqrt(profiles) * weight
    far = (b**2).sum(1) - 2 * a @ b.T
    short = np.argpartition(far, SHORT_LIST, axis=1)[:, :SHORT_LIST]
    w = np.repeat(GROUP_WEIGHT, np.diff(GROUPS))
    hp = (_entropy(profiles) * w).sum(1)
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for j in range(SHORT_LIST):
        k = short[:, j]
        d = (_entropy((x + profiles[k]) / 2) * w).sum(1) - hp[k] / 2
        better = (d < best) | ((d == best) & (k < at))
        best, at = np.where(better, d, best), np.where(better, k, at)
    limit = 2 * (best - (_entropy(x) * w).sum(1) / 2) - (a**2).sum(1) + 1e-6  # rounding of the bound
    near = far <= limit[:, None]
    np.put_along_axis(near, short, False, axis=1)
    for k in np.flatnonzero(near.any(0)):
        i = np.flatnonzero(near[:, k])
        d = (_entropy((x[i] + profiles[k]) / 2) * w).sum(1) - hp[k] / 2
        better = (d < best[i]) | ((d == best[i]) & (k < at[i]))
        best[i], at[i] = np.where(better, d, best[i]), np.where(better, k, at[i])
    return at


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Profiles, their kinds (1 prose, 0 other) and names."""
    m = np.load(MODEL, allow_pickle=False)
    return m["profiles"], m["prose"], m["names"]


def prose_lines(ln: Lines) -> np.ndarray:
    """Is each line prose?  Nearest profile; the rest of a wrapped sentence follows it."""
    if not len(ln.x):
        return np.zeros(0, bool)
    profiles, prose, _ = model()
    ok = prose[nearest(ln.x, profiles)].astype(bool)
    # a basic count: a dozen words in a row without one common word are no sentence
    ok &= (ln.n_words < BARE_WORDS) | (ln.common > 0) | (ln.tail == 0)
    # lines of a wrapped sentence follow the prose line they continue or that continues them
    same = ln.row[1:] == ln.row[:-1]
    plain = (ln.chars[:, 0] + ln.chars[:, 2] > 0.85 * ln.chars.sum(1)) & (ln.head <= 1)
    runs_on = (ln.tail != 0) & (ln.tail != 4) & (ln.tail != 3) & (ln.n_words >= 5)
    short_end = (ln.tail == 0) & (ln.n_words <= 6)
    member = plain & (short_end | (ln.n_words >= 5) & (ln.common > 0))
    # down to the end of every chain of such lines, then up: nothing is left to follow
    ok = _followed(ok, runs_on[:-1] & same & member[1:])
    return _followed(ok[::-1], ((ln.head[1:] == 1) & runs_on[:-1] & same & member[:-1])[::-1])[::-1]


def _followed(ok: np.ndarray, link: np.ndarray) -> np.ndarray:
    """``ok`` carried on over unbroken links from each line to the next."""
    idx = np.arange(len(ok))
    chain = np.maximum.accumulate(np.where(np.concatenate([[False], link]), 0, idx))
    return np.maximum.accumulate(np.where(ok, idx, -1)) >= chain


def judged(ln: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(ink, ink of prose lines) of each row."""
    ok = prose_lines(ln)
    total = np.bincount(ln.row, weights=ln.weight, minlength=ln.n_rows)
    return total, np.bincount(ln.row, weights=ln.weight * ok, minlength=ln.n_rows)


def function_words(df: DataFrame | None, lang_col: str = "lang", word_col: str = "word") -> np.ndarray:
    """Sorted hashes of the common words (a fixed table, collected with its bound checked)."""
    if df is None:
        return np.zeros(0, np.uint64)
    rows = df.select(word_col).where(F.col(word_col).isNotNull()).distinct().limit(MAX_FUNCTION_WORDS + 1).collect()
    if len(rows) > MAX_FUNCTION_WORDS:
        raise ValueError(f"more than {MAX_FUNCTION_WORDS} common words")
    c, o = C.unify(*C.decode(pa.array([r[0] for r in rows], pa.string())))
    c = C.lower_table()[c]
    return np.unique(C.word_hashes(c, *C.words(c, o)[:2]))


STATS = "n_words long, mean_word_length double, symbol_share double, digit_share double, line_end_share double, common_share double, prose_share double, profile string"


def text_statistics(df: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts and shares, share of ink in prose lines, nearest profile, is_prose)."""
    fw = function_words(common)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        ln = Lines(*clean(b.column(1)), fw)
        total, prose = judged(ln)
        n = ln.n_rows
        by = lambda v: np.bincount(ln.row, weights=v, minlength=n)
        words, lines = by(ln.n_words), by(np.ones(len(ln.row)))
        letters = by(ln.chars[:, 0] + ln.chars[:, 1])
        body = by(ln.chars.sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cols = {
                "mean_word_length": letters / words,
                "symbol_share": by(ln.chars[:, 6:].sum(1)) / body,
                "digit_share": by(ln.chars[:, 1]) / body,
                "line_end_share": by((ln.tail == 0).astype(float)) / lines,
                "common_share": by(ln.common) / words,
                "prose_share": prose / total,
            }
        profiles, _, names = model()
        mean = np.stack([by(ln.x[:, k] * ln.weight) for k in range(ln.x.shape[1])], axis=1) / np.maximum(total, 1)[:, None] if len(ln.x) else np.zeros((n, int(GROUPS[-1])))
        near = names[nearest(mean, profiles)]
        blank = total == 0
        out = {k: pa.array(np.where(blank | ~np.isfinite(v), 0.0, v), mask=blank | ~np.isfinite(v)) for k, v in cols.items()}
        return batch_of(id=b.column(0), n_words=pa.array(words.astype(np.int64), mask=blank), **out, profile=pa.array(near.tolist(), pa.string(), mask=blank))

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = map_text(src, "t", fn, "id long, " + STATS)
    return out.withColumn("is_prose", F.col("prose_share") >= 0.5).withColumnRenamed("id", id_col)


def not_prose(df: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of the documents that are for the most part not made of sentences."""
    fw = function_words(common)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        total, prose = judged(Lines(*clean(b.column(1)), fw))
        bad = (total > 0) & (prose < 0.5 * total)
        return batch_of(id=b.column(0).filter(pa.array(bad))) if bad.any() else None

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null and id is not null")
    return map_text(src, "t", fn, "id long").select(F.col("id").alias(id_col)).distinct()
