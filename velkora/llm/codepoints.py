"""Whole-batch Unicode work on numpy code-point arrays.

An Arrow string column becomes one flat ``uint32`` array of code points plus row
offsets; every later step (folding look-alikes, composing marks, cutting words,
hashing words and word windows) is a table gather or a segmented reduction over that
flat array.  No step calls a string method once per row.

Defined results for odd input: null is treated as the empty text by :func:`decode`
(callers keep the null mask themselves); empty rows have equal start and end offsets.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

N_CP = 0x110000
SLASH = 0x2044  # the fraction slash
U64 = np.uint64

# ---------------------------------------------------------------- Arrow <-> code points


def decode(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points and row offsets (n+1) of a string array; nulls are empty rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    raw = bytes(memoryview(bufs[2])[off[0] : off[-1]]) if bufs[2] is not None and off[-1] > off[0] else b""
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[off - off[0]]


def encode(cps: np.ndarray, off: np.ndarray) -> pa.Array:
    """Inverse of :func:`decode` (rows become non-null strings)."""
    c = cps
    width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    ends = np.zeros(len(c) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    raw = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    return pa.LargeStringArray.from_buffers(
        len(off) - 1, pa.py_buffer(ends[off].astype(np.int64).tobytes()), pa.py_buffer(raw)
    )


# ---------------------------------------------------------------- one consistent form

# Letters of other scripts whose usual glyph is that of a Latin letter.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ս": "u", "ɡ": "g", "ɑ": "a",
    "‐": "-", "‑": "-", "‒": "–", "ʼ": "’", "․": ".", "ꞏ": "·", "∙": "·", "⋅": "·",
}
#: Compatibility forms that look like what they stand for (the others, such as
#: superscripts, fractions or circled digits, look different and are kept).
_COMPAT_TAGS = ("<wide>", "<narrow>", "<noBreak>")
_COMPAT_RANGES = ((0xFB00, 0xFB07), (0x0132, 0x0134), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x2160, 0x2180))
_NO_INK_EXTRA = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
_INK_CF = (0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)


def _folded(ch: str) -> str:
    """What one character becomes before marks are ordered and composed."""
    o, cat = ord(ch), unicodedata.category(ch)
    if ch in "\n\r  \v\f\x85":
        return "" if ch == "\x85" else "\n"
    if ch == "\t" or cat == "Zs":
        return " "
    if cat == "Cc" or (cat == "Cf" and o not in _INK_CF) or o in _NO_INK_EXTRA:
        return ""
    if 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return ""
    if 0xAC00 <= o <= 0xD7A3:
        return ch
    d = unicodedata.decomposition(ch)
    if d.startswith("<"):
        tag, *parts = d.split()
        if tag in _COMPAT_TAGS or any(a <= o < b for a, b in _COMPAT_RANGES):
            return "".join(_folded(chr(int(p, 16))) for p in parts)
        return ch
    return "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFD", ch))


class Tables:
    """Lookup tables of the one consistent form, built by rule from the Unicode data."""

    def __init__(self) -> None:
        one = np.arange(N_CP, dtype=np.uint32)  # image where it is a single code point
        size = np.ones(N_CP, np.uint8)  # length of the image
        start = np.zeros(N_CP, np.int64)  # where a longer image stands in `more`
        more: list[int] = []
        ccc = np.zeros(N_CP, np.uint8)
        blocks = (*range(0x0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x1E000), *range(0x1F000, 0x1FC00), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0))
        pairs: dict[int, int] = {}
        for o in blocks:
            ch = chr(o)
            if c := unicodedata.combining(ch):
                ccc[o] = c
            if unicodedata.category(ch) in ("Cn", "Co", "Cs"):
                continue
            f = _folded(ch)
            if f != ch:
                size[o] = len(f)
                if len(f) == 1:
                    one[o] = ord(f)
                elif f:
                    start[o] = len(more)
                    more.extend(map(ord, f))
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<" and " " in d:
                a, b = (int(x, 16) for x in d.split())
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    pairs[(a << 21) | b] = o
        for lead in range(19):  # Hangul syllables compose by formula
            for vowel in range(21):
                lv = 0xAC00 + (lead * 21 + vowel) * 28
                pairs[((0x1100 + lead) << 21) | (0x1161 + vowel)] = lv
                for tail in range(1, 28):
                    pairs[(lv << 21) | (0x11A7 + tail)] = lv + tail
        self.one, self.size, self.start, self.ccc = one, size, start, ccc
        self.more = np.array(more, np.uint32)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_val = np.array([pairs[k] for k in self.pair_key.tolist()], np.uint32)
        seconds = np.zeros(N_CP, bool)
        seconds[[k & 0x1FFFFF for k in pairs]] = True
        self.second = seconds
        # vulgar fractions by their digits: numerator, then one or two digits of the denominator
        whole: dict[int, int] = {}
        for o in range(0xA0, 0x2200):
            tag, *parts = unicodedata.decomposition(chr(o)).split() or [""]
            seq = [int(p, 16) for p in parts]
            if tag == "<fraction>" and len(seq) in (3, 4) and seq[1] == SLASH:
                whole[(seq[0] << 42) | (seq[2] << 21) | (seq[3] if len(seq) == 4 else 0)] = o
        self.fraction_key = np.array(sorted(whole), np.int64)
        self.fraction_val = np.array([whole[k] for k in self.fraction_key.tolist()], np.uint32)


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _rows_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))


def _keep(cps: np.ndarray, off: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    acc = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(mask, out=acc[1:])
    return cps[mask], acc[off]


def _row_starts(off: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, bool)
    s = off[:-1]
    first[s[s < n]] = True
    return first


def unify(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One consistent form: look-alike letters, full-width forms, ligatures, blanks and
    combining marks become their common characters; digits around a fraction slash become
    the fraction they are shown as; characters without ink vanish; every line break becomes ``\\n``.  Case, accents and words stay.  Idempotent."""
    t = tables()
    if len(cps) == 0:
        return cps, off
    # \r\n is one line break
    cr = cps == 13
    if cr.any():
        nxt = np.zeros(len(cps), bool)
        nxt[:-1] = cps[1:] == 10
        ends = off[1:] - 1
        nxt[ends[(ends >= 0)]] &= False
        cps, off = _keep(cps, off, ~(cr & nxt))
    size = t.size[cps]
    if (size == 1).all():
        out = t.one[cps]
    else:
        size = size.astype(np.int64)
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        src = np.repeat(cps, size)
        out = t.one[src]
        rank = np.arange(len(src)) - np.repeat(at[:-1], size)
        long = t.size[src] > 1
        out[long] = t.more[t.start[src[long]] + rank[long]]
        off = at[off]
    ccc = t.ccc[out]
    if ccc.any():
        out = _order_marks(out, off, ccc)
    return _fractions(*_compose(out, off, t), t)


def _order_marks(cps: np.ndarray, off: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Canonical order: marks of one base sorted by class, stably."""
    first = _row_starts(off, len(cps))
    back = np.zeros(len(cps), bool)
    back[1:] = (ccc[1:] > 0) & (ccc[1:] < ccc[:-1]) & ~first[1:]
    if not back.any():
        return cps
    group = np.cumsum((ccc == 0) | first)
    order = np.lexsort((np.arange(len(cps)), ccc, group))
    return cps[order]


def _compose(cps: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition of base and mark, round by round over all rows at once."""
    while len(cps):
        ccc = t.ccc[cps]
        maybe = t.second[cps]
        first = _row_starts(off, len(cps))
        maybe &= ~first
        idx = np.flatnonzero(maybe)
        if len(idx) == 0:
            break
        # the last starter before each position, inside its row
        base = np.where((ccc == 0) | first, np.arange(len(cps)), 0)
        np.maximum.accumulate(base, out=base)
        prev = idx - 1
        b = np.where(ccc[idx] == 0, prev, base[prev])
        free = (prev == b) | ((ccc[prev] != 0) & (ccc[prev] < ccc[idx]))
        free &= ccc[b] == 0
        idx, b = idx[free], b[free]
        key = (cps[b].astype(np.int64) << 21) | cps[idx]
        pos = np.searchsorted(t.pair_key, key)
        pos[pos == len(t.pair_key)] = 0
        hit = t.pair_key[pos] == key
        idx, b, pos = idx[hit], b[hit], pos[hit]
        if len(idx) == 0:
            break
        _, once = np.unique(b, return_index=True)  # the first mark of each base
        idx, b, pos = idx[once], b[once], pos[once]
        clash = np.isin(b, idx)  # a base that is itself taken in this round waits
        idx, b, pos = idx[~clash], b[~clash], pos[~clash]
        cps = cps.copy()
        cps[b] = t.pair_val[pos]
        mask = np.ones(len(cps), bool)
        mask[idx] = False
        cps, off = _keep(cps, off, mask)
    return cps, off


def _fractions(cps: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """A digit, a fraction slash and one or two digits, with no digit or slash beside them, become one character."""
    at = np.flatnonzero(cps == SLASH)
    if not len(at):
        return cps, off
    row = np.searchsorted(off, at, side="right") - 1
    get = lambda i: np.where((i >= off[row]) & (i < off[row + 1]), cps[np.clip(i, 0, len(cps) - 1)], 0).astype(np.int64)
    digit = lambda x: (x >= 48) & (x <= 57)
    ahead, top, one, two = get(at - 2), get(at - 1), get(at + 1), get(at + 2)
    long = digit(two)
    beyond = np.where(long, get(at + 3), two)
    key = (top << 42) | (one << 21) | np.where(long, two, 0)
    pos = np.minimum(np.searchsorted(t.fraction_key, key), len(t.fraction_key) - 1)
    ok = (t.fraction_key[pos] == key) & ~digit(ahead) & ~digit(beyond) & (ahead != SLASH) & (beyond != SLASH)
    at, long, pos = at[ok], long[ok], pos[ok]
    cps = cps.copy()
    cps[at - 1] = t.fraction_val[pos]
    mask = np.ones(len(cps), bool)
    mask[np.concatenate([at, at + 1, at[long] + 2])] = False
    return _keep(cps, off, mask)


# ---------------------------------------------------------------- classes and folds


@functools.lru_cache(maxsize=64)
def one_of(chars: str) -> np.ndarray:
    """True for the characters of a string."""
    s = np.zeros(N_CP, bool)
    s[[ord(x) for x in chars]] = True
    return s


def among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Is each value one of the sorted ones?"""
    if len(sorted_values) == 0 or len(x) == 0:
        return np.zeros(len(x), bool)
    p = np.searchsorted(sorted_values, x)
    p[p == len(sorted_values)] = 0
    return sorted_values[p] == x


@functools.lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """True for letters and digits (a word is a run of these)."""
    s = np.zeros(N_CP, bool)
    for o in (*range(0x0, 0xD800), *range(0xF900, 0x32400)):
        if chr(o).isalnum():
            s[o] = True
    return s


@functools.lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    s = np.arange(N_CP, dtype=np.uint32)
    for o in (*range(0x0, 0x3400), *range(0xA000, 0xAC00), *range(0xFF00, 0x10600), *range(0x1E900, 0x1E944)):
        lo = chr(o).lower()
        if len(lo) == 1 and ord(lo) != o:
            s[o] = ord(lo)
    return s


@functools.lru_cache(maxsize=1)
def base_table() -> np.ndarray:
    """Lower-case letter without accents; 0 for combining marks.  A small letter whose
    capital looks like a Latin one counts as that one (the text was disguised, then lowered)."""
    s = lower_table().copy()
    for o in (*range(0x370, 0x530),):
        up = chr(o).upper()
        if chr(o) not in LOOKALIKES and up in LOOKALIKES:
            s[o] = ord(LOOKALIKES[up].lower())
    for o in (*range(0x80, 0x3400), *range(0x1E00, 0x2000)):
        if unicodedata.combining(chr(o)):
            s[o] = 0
            continue
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and unicodedata.combining(d[1]):
            b = chr(s[ord(d[0])])
            s[o] = ord(b) if len(b) == 1 else ord(d[0])
    return s


def fold_spelling(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Comparison form: lower case, no accents, and x after c g h j s u dropped
    (so ``cx``, ``ĉ`` and ``c`` are one letter)."""
    f = base_table()[cps]
    f, off = _keep(f, off, f != 0)
    if len(f) == 0:
        return f, off
    x = np.zeros(len(f), bool)
    x[1:] = (f[1:] == ord("x")) & one_of("cghjsu")[f[:-1]]
    x &= ~_row_starts(off, len(f))
    return _keep(f, off, ~x)


# ---------------------------------------------------------------- words and windows

_P = U64(0x9E3779B97F4A7C15 | 1)
_Q = U64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> U64(30)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
    return h


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    p = np.full(n, _P, np.uint64)
    p[0] = U64(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def words(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets by row) of every run of letters and digits."""
    isw = alnum_table()[cps]
    n = len(cps)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first = _row_starts(off, n)
    begin = isw.copy()
    begin[1:] &= ~isw[:-1] | first[1:]
    end = isw.copy()
    end[:-1] &= ~isw[1:] | first[1:]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word [s, e)."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    size = e - s
    flat = np.repeat(s, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    with np.errstate(over="ignore"):
        at = flat - np.repeat(s, size)
        p = _powers(1 << max(6, int(size.max()).bit_length()))
        v = (cps[flat].astype(np.uint64) + U64(1)) * p[at]
        h = np.add.reduceat(v, np.cumsum(size) - size)
        return mix(h ^ (size.astype(np.uint64) << U64(40)))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (rows ignored; see :func:`window_ok`)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for j in range(1, k):
            acc *= _Q
            acc += h[j : j + n]
        return mix(acc ^ U64(k))


def window_ok(woff: np.ndarray, k: int) -> np.ndarray:
    """Positions (into :func:`windows`) whose k words stand in one row, and their rows."""
    n = int(woff[-1]) - k + 1 if len(woff) else 0
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z
    row = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    pos = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return pos, row[pos]
