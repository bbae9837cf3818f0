"""Fits the small models stored in ``models/`` (run by hand, not by queries).

    python -m velkora.llm.train profiles|languages|calibrate|residue FOLDER

FOLDER holds the driver's tables; a bounded number of documents is read (see the
constants).  Nothing outside this file depends on it.
"""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds

from . import codepoints as C
from . import garble, prose

#: Most documents a fit reads.
MAX_DOCUMENTS = 40_000
MODELS = Path(__file__).with_name("models")


def _table(folder: str, name: str, *cols: str) -> pa.Table:
    return ds.dataset(f"{folder}/{name}.parquet").head(MAX_DOCUMENTS, columns=list(cols))


def _hashed(t: pa.Table) -> np.ndarray:
    """Hashes of the first column, by which rows are drawn wherever they stand."""
    return C.mix(t.column(0).to_numpy().astype(np.uint64)) >> np.uint64(32)


def _sample(folder: str, name: str, *cols: str) -> pa.Table:
    """At most MAX_DOCUMENTS rows, drawn by a hash of the first column."""
    t = ds.dataset(f"{folder}/{name}.parquet").to_table(columns=list(cols))
    h = _hashed(t)
    return t.take(np.sort(np.argsort(h, kind="stable")[:MAX_DOCUMENTS]))


def _outside(folder: str, name: str, col: str, key: str = "doc_id"):
    """The texts that ``_sample`` leaves out, in slices."""
    t = ds.dataset(f"{folder}/{name}.parquet").to_table(columns=[key, col])
    rest = t.take(np.sort(np.argsort(_hashed(t), kind="stable")[MAX_DOCUMENTS:]))[col].combine_chunks()
    for lo in range(0, len(rest), 1000):
        yield rest.slice(lo, 1000)


def _common(folder: str) -> np.ndarray:
    words = _table(folder, "common_words", "word")["word"].combine_chunks()
    c, o = C.unify(*C.decode(words))
    c = C.lower_table()[c]
    return np.unique(C.word_hashes(c, *C.words(c, o)[:2]))


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means in Hellinger space, returned as distributions."""
    y = np.sqrt(x)
    c = y[rng.choice(len(y), min(k, len(y)), replace=False)]
    for _ in range(rounds):
        near = ((y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1)).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = y[near == j].mean(0)
    near = ((y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1)).argmin(1)
    return np.stack([x[near == j].mean(0) for j in range(len(c)) if (near == j).sum() >= 3])


def _kind(p: np.ndarray, is_prose: bool) -> str:
    """A readable name of a profile, by its plainest trait."""
    char, word, head, tail, count = (p[a:b] for a, b in zip(prose.GROUPS, prose.GROUPS[1:], strict=False))
    if is_prose:
        return "dialogue" if head[3] > 0.5 else "prose" if tail[0] > 0.5 else "wrapped prose" if head[1] > 0.4 else "verse"
    if char[8] > 0.3:
        return "symbols"
    if word[5] > 0.3:
        return "noise"
    if word[4] > 0.3:
        return "code or log"
    if char[7] > 0.12 or word[3] > 0.4:
        return "table"
    if head[2] + head[3] + head[4] > 0.5 or count[:3].sum() > 0.6:
        return "list"
    return "keywords"


def profiles(folder: str) -> None:
    """Profiles of lines of clearly prosaic and clearly other documents.

    A document is clearly prose when its lines hold many common words and most of them
    end like sentences or run on; clearly other when common words are nearly absent or
    its lines are short and end like no sentence.
    """
    fw, rng = _common(folder), np.random.default_rng(7)
    texts = _table(folder, "documents", "text")["text"].combine_chunks()
    good, bad = [], []
    for lo in range(0, min(len(texts), MAX_DOCUMENTS), 1000):
        ln = prose.Lines(*prose.clean(texts.slice(lo, 1000)), fw)
        by = lambda v, ln=ln: np.bincount(ln.row, weights=v, minlength=ln.n_rows)
        n, words = np.maximum(by(np.ones(len(ln.row))), 1), np.maximum(by(ln.n_words), 1)
        common, ends, per = by(ln.common) / words, by((ln.tail == 0).astype(float)) / n, words / n
        size = np.maximum(by(ln.chars.sum(1)), 1)
        letters = by(ln.chars[:, 0] + ln.chars[:, 2]) / size
        is_good = (letters > 0.85) & ((common > 0.2) & (ends >= 0.9) & (per > 7) | (common > 0.16) & (ends >= 0.9) & (per > 20) | (common > 0.17) & (per >= 5.2) & (letters > 0.93) & (by(np.isin(ln.head, (2, 3, 4)).astype(float)) == 0))
        is_bad = (common < 0.05) | ((per < 4.6) & (ends < 0.1)) | (letters < 0.6)
        w = ln.n_words
        share = np.column_stack([ln.x, ln.weight / np.maximum(by(ln.weight), 1)[ln.row]])  # a document counts once
        good.append(share[is_good[ln.row] & (w >= 3)])
        bad.append(share[is_bad[ln.row] & ~((ln.tail == 0) & (w >= 5) & (ln.common >= 1))])
    g, b = np.concatenate(good), np.concatenate(bad)
    pick = lambda m, k: m[rng.choice(len(m), k, p=m[:, -1] / m[:, -1].sum())][:, :-1]
    cg, cb = _centres(pick(g, 40_000), 40, rng), _centres(pick(b, 40_000), 80, rng)
    MODELS.mkdir(exist_ok=True)
    names = [_kind(p, True) for p in cg] + [_kind(p, False) for p in cb]
    np.savez_compressed(prose.MODEL, profiles=np.concatenate([cg, cb]).astype(np.float32), prose=np.array([1] * len(cg) + [0] * len(cb), np.int8), names=np.array(names))
    print(len(g), "lines of prose,", len(b), "others")


#: Records of trusted kinds that stand for one placeholder each, of every shape.
EXAMPLES = (
    "{{ nomo }}", "${nomo}", "{nomo}", "{% nomo %}", "<%= nomo %>", "%NOMO%", "%(nomo)s",
    "__nomo__", "##NOMO##", "@@nomo@@", "[[nomo]]", "[ENIGU NOMON]", "<nomo>",
)


def residue(folder: str, rounds: int = 8, prior: float = 0.01, trust: float = 6.0, smooth: float = 0.05) -> None:
    """Positive-unlabelled naive Bayes by expectation-maximization over passages.

    Trusted passages (``residue.TRUSTED``, filler that opens as filler does, placeholders of
    sound texts that nothing speaks of) keep the label; records that speak of such things
    (``residue.SPOKEN`` with a placeholder of every shape) count as unlabelled and never
    trusted; every other passage takes the posterior of the round before.  A placeholder is
    a passage of its own, so that the words around it are not taught as residue.
    """
    from . import residue as R

    documents = _sample(folder, "documents", "doc_id", "text")
    texts = documents["text"].combine_chunks()
    toks, lens, barred, marked = [], [], [], []
    fw = _common(folder)
    part = R.PART
    for lo in range(0, len(texts), 1000):
        c, o = prose.clean(texts.slice(lo, 1000))
        rows = C.encode(c, o).to_pylist()
        total, good = prose.judged(prose.Lines(c, o, fw))
        # noise and text with lost letters is never a message
        bad = [g < 0.5 * n or bool(garble.spans(t)) for t, n, g in zip(rows, total, good, strict=True)]
        cut, flag = [], []
        for t, x in zip(rows, bad, strict=True):
            ps = [q for p in _passages(R.as_words(t, R.placeholders(t))) for q in _parted(p, part)]
            cut += ps
            flag += [x] * len(ps)
        h, woff, _ = R.tokens(pa.array(cut, pa.string()))
        toks.append(h)
        lens.append(np.diff(woff))
        barred.append(np.array(flag, bool))
        marked.append(np.array([p.startswith(part) and not p.startswith(part + "q") and "q " not in p for p in cut], bool))
    spoken = [t.replace("{}", x) for t in R.SPOKEN for x in EXAMPLES]
    h, woff, _ = R.tokens(pa.array(R.TRUSTED + [f"{x} {x}" for x in EXAMPLES] + spoken, pa.string()))
    n_trusted, n_own = len(R.TRUSTED) + len(EXAMPLES), len(R.TRUSTED) + len(EXAMPLES) + len(spoken)
    h = np.concatenate([h, *toks])
    size = np.concatenate([np.diff(woff), *lens])
    barred = np.concatenate([np.zeros(n_trusted, bool), np.ones(len(spoken), bool), *barred])
    marked = np.concatenate([np.zeros(n_own, bool), *marked]) & ~barred
    off = np.concatenate([[0], np.cumsum(size)])
    passage = np.repeat(np.arange(len(size)), size)
    p2 = R.pairs(h)
    inner = np.ones(len(h), bool)
    inner[off[1:][size > 0] - 1] = False
    feats = np.concatenate([h, p2[inner]])
    where = np.concatenate([passage, passage[inner]])
    token, idx, count = np.unique(feats, return_inverse=True, return_counts=True)
    first = np.zeros(len(size), np.uint64)
    first[size > 1] = p2[off[:-1][size > 1]]
    opening = R.pairs(R.tokens(pa.array(["lorem ipsum"]))[0])[0]
    sure = (np.arange(len(size)) < n_trusted) | ((first == opening) & ~barred) | marked  # filler that opens as filler does
    post = sure.astype(float)
    keep = count >= 3
    for r in range(rounds):
        w = np.where(marked, 0.2, np.where(sure, trust, 1.0))  # placeholders are many: they must not outweigh messages
        pos = np.bincount(idx, weights=(post * w)[where], minlength=len(token))
        neg = np.bincount(idx, weights=(1 - post)[where], minlength=len(token))
        lp = np.log((pos + smooth) / (pos.sum() + smooth * len(token))) - np.log((neg + smooth * 20) / (neg.sum() + smooth * 20 * len(token)))
        lp = np.where(pos < 0.5, np.minimum(lp, -0.5), lp)  # never seen in a message: no evidence for one
        # the score of a passage: one weight for each word and pair; long passages are not more certain
        s = np.bincount(where, weights=np.clip(lp[idx], -6, 6), minlength=len(size))
        s = s / np.maximum(size, 1) ** 0.5 * 2.0
        new = 1 / (1 + np.exp(-np.clip(s + np.log(prior / (1 - prior)), -30, 30)))
        new[(size < 4) | barred] = 0.0
        new[sure] = 1.0
        print("round", r, "positive passages", int((new > 0.5).sum()), "of", len(size))
        post = new
    unknown = -0.7
    np.savez_compressed(R.MODEL, token=token[keep | (pos > 1)], weight=np.clip(lp, -6, 6)[keep | (pos > 1)].astype(np.float16), unknown=unknown)
    R.model.cache_clear()
    best = np.concatenate([R.scores(t)[0] for t in _outside(folder, "documents", "text")])
    print("documents outside the sample:", len(best), "scores by fives up to 100:", np.histogram(best, bins=np.append(np.arange(0, 105, 5), np.inf))[0].tolist())


def _parted(passage: str, part: str) -> list[str]:
    """A passage cut around the words that stand for placeholders."""
    import regex

    return [p.strip() for p in regex.split(rf"({part}o\w+ {part}\w* {part}e\w+)", passage) if p.strip()]


def _passages(text: str) -> list[str]:
    """Sentences; a line break ends one unless the next line goes on in small letters."""
    import regex

    return [p for p in regex.split(r"(?<=[.!?…])[”“\"]?\s+|\n(?!\s*\p{Ll})", text) if p.strip()]


def languages(folder: str, epochs: int = 6, reg: float = 1e-5) -> None:
    """Linear support vector machines on stretches whose label and common words agree.

    The class of no language is taught filler and lines of documents that are no prose.
    """
    from . import languages as L

    t = _table(folder, "documents", "text", "lang")
    texts, labels = t["text"].combine_chunks(), t["lang"].to_pylist()
    cw = _table(folder, "common_words", "lang", "word").to_pandas()
    of = {}
    for lang, g in cw.groupby("lang"):
        c, o = C.unify(*C.decode(pa.array(g["word"].tolist(), pa.string())))
        of[L.LANGUAGES.index(lang)] = np.unique(C.word_hashes(C.lower_table()[c], *C.words(c, o)[:2]))
    opening = C.word_hashes(*(lambda c, o: (c, *C.words(c, o)[:2]))(*C.decode(pa.array(["lorem ipsum"]))))
    fw = _common(folder)
    data = []
    for lo in range(0, len(texts), 1000):
        c, o = prose.clean(texts.slice(lo, 1000))
        total, good = prose.judged(prose.Lines(c, o, fw))
        w = L.Words(c, o)
        votes = np.stack([np.add.reduceat(np.isin(w.h, of[k]).astype(float), w.seg_start) for k in range(7)], axis=1)
        code = np.array([_code(x) for x in labels[lo : lo + 1000]])[w.seg_row]
        top = votes.argmax(1)
        second = np.sort(votes, axis=1)[:, -2]
        y = np.where((votes.max(1) >= 2) & (votes.max(1) > second) & (top == code) & (w.seg_size >= 5), top, -1)
        # a tie between languages goes to the label where clear stretches of the document agree with it
        clear = np.zeros((w.n_rows, 7))
        np.add.at(clear, (w.seg_row[y >= 0], y[y >= 0]), 1)
        sure = (clear.sum(1) >= 2) & (clear.max(1) == clear.sum(1))
        tie = (code >= 0) & (votes.max(1) >= 1) & (votes[np.arange(len(code)), np.maximum(code, 0)] == votes.max(1)) & sure[w.seg_row] & (clear.argmax(1)[w.seg_row] == code)
        y = np.where((y < 0) & tie & (w.seg_size >= 5), code, y)
        lorem = np.add.reduceat(np.isin(w.h, opening).astype(float), w.seg_start)
        filler = np.isin(w.seg_row, w.seg_row[lorem >= 1]) & (votes.max(1) == 0) & (w.seg_size >= 4) & (good[w.seg_row] > 0)
        y = np.where(filler | ((good == 0) & (total > 0))[w.seg_row] & (w.seg_size >= 3) & (votes.max(1) <= 1), L.NONE, y)
        data.append((w, y))
    words, counts = np.unique(np.concatenate([w.h[np.isin(w.seg, np.flatnonzero(y >= 0)) & ~w.name] for w, y in data]), return_counts=True)
    named, times = np.unique(np.concatenate([w.h[w.name] for w, _ in data]), return_counts=True)
    at = np.minimum(np.searchsorted(named, words), len(named) - 1)
    as_name = np.where(named[at] == words, times[at], 0)
    words = words[(counts >= 4) & (as_name * 2 < counts)]  # names are no features, nor where they open a sentence
    # feature lists of each stretch
    feat, val, row, target, size, n = [], [], [], [], [], 0
    for w, y in data:
        order = np.argsort(w.tri_word, kind="stable")
        tri, tw = w.tri[order], w.tri_word[order]
        toff = np.searchsorted(tw, np.arange(len(w.uniq) + 1))
        take = np.isin(w.seg, np.flatnonzero(y >= 0)) & ~w.name
        inv, seg = w.inv[take], w.seg[take]
        local = np.cumsum(np.concatenate([[0], (y >= 0)[:-1]]))[seg] + n
        p = np.searchsorted(words, w.uniq[inv])
        p[p == len(words)] = 0
        known = words[p] == w.uniq[inv]
        feat.append(p[known]); val.append(np.ones(known.sum())); row.append(local[known])  # noqa: E702
        k = (toff[1:] - toff[:-1])[inv]
        at = np.repeat(toff[inv] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        feat.append(tri[at] + len(words)); val.append(np.repeat(w.tri_weight[inv], k)); row.append(np.repeat(local, k))  # noqa: E702
        target.append(y[y >= 0]); size.append(w.seg_size[y >= 0])  # noqa: E702
        n += int((y >= 0).sum())
    feat, val, row = np.concatenate(feat), np.concatenate(val), np.concatenate(row)
    y, size = np.concatenate(target), np.concatenate(size)
    order = np.argsort(row, kind="stable")
    feat, val, row = feat[order], val[order] / size[row[order]], row[order]
    off = np.searchsorted(row, np.arange(n + 1))
    print("stretches by class", np.bincount(y), "words", len(words))
    family = np.array([0, 0, 1, 1, 2, 2, 3, 4])[y]
    t_ = np.full((n, 8), np.nan)
    for f in range(5):
        t_[:, f] = np.where(family == f, 1, -1)
    for k in range(3):
        t_[y == 2 * k, 5 + k], t_[y == 2 * k + 1, 5 + k] = 1, -1
    weight = np.minimum(2000 / np.bincount(y, minlength=8), 1.0)[y]
    rng = np.random.default_rng(3)
    held_out = rng.random(n) < 0.1
    W, b = np.zeros((len(words) + L.BUCKETS, 8)), np.zeros(8)
    h2 = np.full(len(W), 1e-8)
    train = np.flatnonzero(~held_out)
    p = weight[train] / weight[train].sum()
    for ep in range(epochs):
        for _ in range(len(train) // 256):
            i = rng.choice(train, 256, p=p)
            k = off[i + 1] - off[i]
            at = np.repeat(off[i] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            r = np.repeat(np.arange(256), k)
            f, v = feat[at], val[at]
            s = np.zeros((256, 8))
            np.add.at(s, r, W[f] * v[:, None])
            s += b
            yt = t_[i]
            loss = np.where(np.isnan(yt), 0.0, np.maximum(0, 1 - yt * s))
            g = -np.where(loss > 0, np.nan_to_num(yt), 0.0) / 16  # hinge
            uf, ui = np.unique(f, return_inverse=True)
            G = np.zeros((len(uf), 8))
            np.add.at(G, ui, g[r] * v[:, None])
            G += reg * W[uf]
            h2[uf] += (G**2).mean(1)
            W[uf] -= 0.4 * G / np.sqrt(h2[uf])[:, None]
            b -= 0.01 * g.mean(0)
        test = np.flatnonzero(held_out)
        s = np.zeros((n, 8))
        for k in range(8):
            s[:, k] = np.bincount(row, weights=W[feat, k] * val, minlength=n) + b[k]
        guess, _ = L.decide(s[test])
        print("epoch", ep, "held-out accuracy", round(float((guess == y[test]).mean()), 5), [round(float((guess == y[test])[y[test] == k].mean()), 4) for k in range(8)])
    np.savez_compressed(L.MODEL, word=words, word_weight=W[: len(words)].astype(np.float16), tri_weight=W[len(words) :].astype(np.float16), bias=b.astype(np.float32))


def calibrate(folder: str) -> None:
    """Confidence of the language machines: the chance that a stretch of a margin is right.

    Fitted by logistic regression on stretches of documents outside the fitted ones, where
    label and common words agree on the language; stored beside the weights."""
    from . import languages as L

    t = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["text", "lang"]).slice(MAX_DOCUMENTS)
    texts, labels = t["text"].combine_chunks(), t["lang"].to_pylist()
    cw = _table(folder, "common_words", "lang", "word").to_pandas()
    of = {}
    for lang, g in cw.groupby("lang"):
        c, o = C.unify(*C.decode(pa.array(g["word"].tolist(), pa.string())))
        of[L.LANGUAGES.index(lang)] = np.unique(C.word_hashes(C.lower_table()[c], *C.words(c, o)[:2]))
    margins, right = [], []
    for lo in range(0, len(texts), 1000):
        w = L.Words(*prose.clean(texts.slice(lo, 1000)))
        if not len(w.h):
            continue
        votes = np.stack([np.add.reduceat(np.isin(w.h, of[k]).astype(float), w.seg_start) for k in range(7)], axis=1)
        code = np.array([_code(x) for x in labels[lo : lo + 1000]])[w.seg_row]
        sure = (votes.max(1) >= 2) & (votes.max(1) > np.sort(votes, axis=1)[:, -2]) & (votes.argmax(1) == code)
        sc = L.word_scores(w)[w.inv]
        sc[w.name] = 0.0
        lang, margin = L.decide(np.add.reduceat(sc, w.seg_start, axis=0) / w.seg_size[:, None] + L.model()[3])
        margins.append(margin[sure])
        right.append((lang == code)[sure])
    m, y = np.minimum(np.concatenate(margins), L.MOST_MARGIN), np.concatenate(right).astype(float)
    x = np.stack([m, np.ones_like(m)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-6 * np.eye(2), x.T @ (y - q))
    print("stretches outside the fitted documents:", len(y), "right:", round(float(y.mean()), 5), "slope and intercept:", beta)
    for a_, b_ in ((0, 0.2), (0.2, 0.5), (0.5, 1), (1, 9)):
        some = (m >= a_) & (m < b_)
        print(f"margin {a_} to {b_}: {int(some.sum())} stretches, right {y[some].mean():.4f}, said {(1 / (1 + np.exp(-x[some] @ beta))).mean():.4f}")
    old = dict(np.load(L.MODEL, allow_pickle=False))
    np.savez_compressed(L.MODEL, **(old | {"calibration": beta}))


def _code(label: str | None) -> int:
    """Index of the language a label names, or -1."""
    from . import languages as L

    head = "".join(ch if ch.isalpha() else " " for ch in (label or "")).split()
    code = head[0].lower() if head else ""
    code = L.ISO3.get(code, code)
    return L.LANGUAGES.index(code) if code in L.LANGUAGES else -1


if __name__ == "__main__":
    globals()[sys.argv[1]](sys.argv[2])
