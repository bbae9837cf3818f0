"""Evaluation passages inside corpus texts, by template windows and slot checks.

Words are compared in the form of :func:`codepoints.fold_spelling`.  Each word of an item
becomes a *template token*: numbers, names and units turn into typed placeholders, other
words stay.  A capital that only opens items may be a name or not, so windows that hold one
stand under both templates.  Template windows of the items (``run`` words of a passage, all
words of a question) are hash-joined with the windows of every document; a candidate then
passes a slot check:

* equal slots -- the passage itself stands in the document (``exact=True``).  The slots
  are part of the join key, so a template of many items costs no more than any other;
* consistent but different slots -- the same item with other numbers or names
  (``exact=False``).  A window needs ``LEAST_PLAIN`` words that are no slots: without them
  it says nothing of the item, any row of numbers would be a copy of it.

The items are a stated, bounded query set.  Up to ``MAX_BROADCAST_CHARS`` characters they
travel to the executors and every text is read once, without a shuffle; beyond that bound
the windows of the texts are joined with those of the items on the same keys, and the same
slot check follows, so the rows are the same.

Defined results: null and blank texts give no row; an item of fewer than ``run`` words in
a passage table never matches; a question without any word is ignored; equal questions
under several ids give a row for each; repeated documents give rows once per id; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from .batches import batch_of, lists_of, map_text

U64 = np.uint64
RUN_WORDS = 12
#: A word takes two characters at least with what parts it from the next, so this bounds words and windows too.
MAX_BROADCAST_CHARS = 8_000_000
#: Least words of a re-parameterised window that are no slots.
LEAST_PLAIN = 3

# Units that fill a unit slot.
UNITS = "g kg mg km m cm mm l dl ml procento procentoj euro eŭroj spesmilo horo horoj minuto minutoj sekundo sekundoj"
NUM, NAME, UNIT = U64(1), U64(2), U64(3)


def _folded_words(arr: pa.Array):
    """Hash, first-letter-is-capital, is-number of each folded word, and row offsets."""
    c, o = C.unify(*C.decode(arr))
    low = C.lower_table()
    caps = (low[c] != c) if len(c) else np.zeros(0, bool)
    # the fold drops characters, so carry the capital flag along
    f = C.base_table()[c]
    keep = f != 0
    caps = caps[keep]
    f, o = C._keep(f, o, keep)
    if len(f):
        sign = C.one_of("cghjsu")[f]
        x = np.zeros(len(f), bool)
        x[1:] = (f[1:] == ord("x")) & sign[:-1]
        x &= ~C._row_starts(o, len(f))
        caps = caps[~x]
        f, o = C._keep(f, o, ~x)
    s, e, woff = C.words(f, o)
    h = C.word_hashes(f, s, e)
    digit = (f >= 48) & (f <= 57)
    number = digit[s] if len(s) else np.zeros(0, bool)
    return h, (caps[s] if len(s) else np.zeros(0, bool)), number, woff


class Typed:
    """How words are typed: sorted hashes of names, of other words and of possible names of the items."""

    def __init__(self, names: np.ndarray, plain: np.ndarray, maybe: np.ndarray) -> None:
        self.names, self.plain, self.maybe = names, plain, maybe
        self.units = np.unique(_folded_words(pa.array([UNITS]))[0])

    def templates(self, h: np.ndarray, cap: np.ndarray, number: np.ndarray, bold: bool = False) -> np.ndarray:
        """Typed placeholder or the word itself; known words are typed alike in any case
        (``bold``: possible names are names)."""
        t = h.copy()
        name = C.among(h, self.names) | (cap & ~C.among(h, self.plain))
        if bold:
            name |= C.among(h, self.maybe)
        t[name] = NAME
        t[C.among(h, self.units)] = UNIT
        t[number] = NUM
        return t

    def item_windows(self, h: np.ndarray, cap: np.ndarray, number: np.ndarray, woff: np.ndarray, k: int):
        """(positions, rows, template hashes, slots by word) of the item windows of k words, under each template."""
        pos, row = C.window_ok(woff, k)
        for bold in (False, True):
            t = self.templates(h, cap, number, bold)
            at = pos
            if bold:
                held = np.concatenate([[0], np.cumsum(C.among(h, self.maybe))])
                some = held[pos + k] > held[pos]
                at, row = pos[some], row[some]
            if len(at):
                yield at, row, C.windows(t, k)[at], t != h


def _vocabulary_of(h: np.ndarray, cap: np.ndarray, number: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, capital inside an item, capital at its opening, small) of the words that are no numbers."""
    first = np.zeros(len(h), bool)
    first[woff[:-1][woff[:-1] < len(h)]] = True
    ok = ~number
    return h[ok], (cap & ~first)[ok], (cap & first)[ok], ~cap[ok]


class Items:
    """Template windows of the query set as sorted numpy arrays."""

    def __init__(self, ids: list[int], texts: list[str | None], runs: list[int]) -> None:
        h, cap, number, woff = _folded_words(pa.array(texts, pa.string()))
        # a name is a word that the items write with a capital inside an item and never without
        w, inside, opens, small = _vocabulary_of(h, cap, number, woff)
        low = np.unique(w[small])
        names = np.setdiff1d(np.unique(w[inside]), low)
        plain = np.setdiff1d(np.unique(w), names)
        self.typed = typed = Typed(names, plain, np.setdiff1d(np.unique(w[opens]), np.union1d(low, names)))
        self.h = h
        self.by_run: dict[int, dict[str, np.ndarray]] = {}
        n_words = np.diff(woff)
        length = np.array([r or n for r, n in zip(runs, n_words, strict=True)], np.int64)
        for k in sorted(set(length.tolist()) - {0}):
            exact = C.windows(h, k)
            parts = []
            for at, row, tw, slot in typed.item_windows(h, cap, number, woff, k):
                want = length[row] == k
                at, row, tw = at[want], row[want], tw[want]
                parts.append((tw, exact[at], np.asarray(ids, np.int64)[row], at, slot[at[:, None] + np.arange(k)]))
            if sum(len(x[0]) for x in parts):
                tw, xw, item, at, slot = (np.concatenate(x) for x in zip(*parts, strict=True))
                same = _slots_and_template(tw, xw)
                one, few = np.argsort(same, kind="stable"), np.argsort(tw, kind="stable")
                few = few[(~slot[few]).sum(1) >= LEAST_PLAIN]
                self.by_run[k] = {"same": same[one], "item": item[one], "template": tw[few], "exact": xw[few], "other": item[few], "at": at[few], "slot": slot[few]}


def _slots_and_template(tw: np.ndarray, xw: np.ndarray) -> np.ndarray:
    """One key of a template window and its words."""
    with np.errstate(over="ignore"):
        return C.mix(tw * U64(0x9E3779B97F4A7C15) + xw)


def _ranges(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which key, which place) of every equal pair."""
    some = np.flatnonzero(C.among(keys, sorted_keys))
    lo, hi = np.searchsorted(sorted_keys, keys[some]), np.searchsorted(sorted_keys, keys[some], side="right")
    n = hi - lo
    return np.repeat(some, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _matches(items: Items, arr: pa.Array, exact: bool):
    """(row of the batch, item id) of every window that passes template and slot check."""
    h, cap, number, woff = _folded_words(arr)
    tokens = items.typed.templates(h, cap, number)
    bold = tokens if exact else items.typed.templates(h, cap, number, True)
    rows, found = [], []
    for k, q in items.by_run.items():
        pos, row = C.window_ok(woff, k)
        if not len(pos):
            continue
        # a document word that the items know only as a possible name stands under both templates too
        xw = C.windows(h, k)[pos]
        for t in (tokens,) if exact else (tokens, bold):
            tw = C.windows(t, k)[pos]
            if exact:
                # the words of an item window carry its template with them: the plain one finds them
                i, j = _ranges(_slots_and_template(tw, xw), q["same"])
                rows.append(row[i])
                found.append(q["item"][j])
                continue
            i, j = _ranges(tw, q["template"])
            other = xw[i] != q["exact"][j]
            i, j = i[other], j[other]
            ok = _consistent(h, pos[i], items.h, q["at"][j], q["slot"][j])
            rows.append(row[i[ok]])
            found.append(q["other"][j[ok]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(rows).astype(np.int64), np.concatenate(found)]), axis=1)
    return both[0], both[1]


def _consistent(h: np.ndarray, pos: np.ndarray, ih: np.ndarray, at: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slots agree: one item value stands for one text value throughout the window, both ways."""
    ok = np.ones(len(pos), bool)
    k = slots.shape[1] if len(slots) else 0
    span = np.arange(k)
    for lo in range(0, len(pos), 4096):
        a, b, slot = h[pos[lo : lo + 4096, None] + span], ih[at[lo : lo + 4096, None] + span], slots[lo : lo + 4096]
        good = np.ones(len(a), bool)
        for i in range(k):
            for j in range(i + 1, k):
                good &= ~(slot[:, i] & slot[:, j]) | ((a[:, i] == a[:, j]) == (b[:, i] == b[:, j]))
        ok[lo : lo + 4096] = good
    return ok


def query_set(passages: DataFrame | None, questions: DataFrame | None, run: int = RUN_WORDS) -> tuple[list, list, list]:
    """Ids, texts and window lengths (0: the whole item) of the evaluation tables on the driver."""
    ids, texts, runs = [], [], []
    for df, k in ((passages, run), (questions, 0)):
        if df is None:
            continue
        for r in df.toLocalIterator():
            ids.append(r[0])
            texts.append(r[1])
            runs.append(k)
    return ids, texts, runs


def leaked_items(docs: DataFrame, passages: DataFrame | None, questions: DataFrame | None, exact: bool = True, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id): ``passages`` and ``questions`` are (item_id, text) frames.

    ``exact=False`` gives the re-parameterised items instead (other slot values, used
    consistently); those that are also there word for word are left out by the slot check.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).where("t is not null and doc_id is not null")
    n = sum(d.agg(F.sum(F.length(F.col(d.columns[1]).cast("string")) + 1)).first()[0] or 0 for d in (passages, questions) if d is not None)
    if n > max_broadcast:
        return _by_join(src, passages, questions, exact)
    ids, texts, runs = query_set(passages, questions)
    if not ids:
        return src.select("doc_id", F.lit(0).cast("long").alias("item_id")).limit(0)
    held = docs.sparkSession.sparkContext.broadcast((ids, texts, runs))
    made: list[Items] = []

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not made:
            made.append(Items(*held.value))
        row, item = _matches(made[0], b.column(1), exact)
        return batch_of(doc_id=b.column(0).take(pa.array(row)), item_id=pa.array(item)) if len(row) else None

    out = map_text(src, "t", fn, "doc_id long, item_id long")
    return out.distinct()


def _vocabulary(items: DataFrame) -> Typed:
    """The typing of the items' words, as ``Items`` has it; one row a distinct word."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        h, inside, opens, small = _vocabulary_of(*_folded_words(b.column(0)))
        return batch_of(h=h.view(np.int64), inside=inside, opens=opens, small=small)

    words = map_text(items.select("t"), "t", fn, "h long, inside boolean, opens boolean, small boolean")
    rows = words.groupBy("h").agg(*[F.max(c).alias(c) for c in ("inside", "opens", "small")]).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    inside, opens, small = (rows[c].to_numpy(bool) for c in ("inside", "opens", "small"))
    name = inside & ~small
    return Typed(np.sort(h[name]), np.sort(h[~name]), np.sort(h[opens & ~small & ~name]))


def _windows_frame(df: DataFrame, key: str, lengths: list[int] | None, typed: Typed, slots: bool, item: bool) -> DataFrame:
    """(key, k, w, x): hashes of every template window and of its exact window, with ``slots``
    also its words h and which of them are slots, s (``lengths`` None: the whole text)."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, cap, number, woff = _folded_words(b.column(1))
        ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
        parts = []
        for k in lengths if lengths is not None else sorted(set(np.diff(woff).tolist()) - {0}):
            for n, (pos, row, w, slot) in enumerate(typed.item_windows(h, cap, number, woff, k)):
                if n and not item and not slots:
                    continue  # word for word the plain template of a text is enough
                ok = np.ones(len(pos), bool)
                if lengths is None:
                    ok = np.diff(woff)[row] == k
                at = pos[:, None] + np.arange(k)
                if slots:
                    ok &= (~slot[at]).sum(1) >= LEAST_PLAIN
                pos, row, w, at = pos[ok], row[ok], w[ok], at[ok].reshape(-1)
                if not len(pos):
                    continue
                cols = {"id": ids[row], "k": np.full(len(pos), k, np.int32), "w": w.view(np.int64), "x": C.windows(h, k)[pos].view(np.int64)}
                if slots:
                    off = np.arange(0, len(at) + 1, k)
                    cols |= {"h": lists_of(h[at].view(np.int64), off), "s": lists_of(slot[at], off)}
                parts.append(batch_of(**cols))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    schema = "id long, k int, w long, x long" + (", h array<long>, s array<boolean>" if slots else "")
    return map_text(df, "t", fn, schema).withColumnRenamed("id", key)


def _by_join(src: DataFrame, passages: DataFrame | None, questions: DataFrame | None, exact: bool = True) -> DataFrame:
    """The same rows for a query set beyond the broadcast bound: a hash join of template
    windows (with their slots, where those are to be equal), then the slot check.  Only the
    distinct words of the items travel."""
    given = []
    for df, lengths in ((passages, [RUN_WORDS]), (questions, None)):
        if df is not None:
            given.append((df.select(F.col(df.columns[0]).cast("long").alias("i"), F.col(df.columns[1]).cast("string").alias("t")).where("t is not null"), lengths))
    texts = given[0][0] if len(given) == 1 else given[0][0].unionByName(given[1][0])
    typed = _vocabulary(texts)
    parts = [_windows_frame(d, "item_id", lengths, typed, not exact, True) for d, lengths in given]
    items = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # a handful of window lengths
    docs = _windows_frame(src, "doc_id", lengths, typed, not exact, False)
    if exact:
        return docs.join(items, ["k", "w", "x"]).select("doc_id", "item_id").distinct()
    j = docs.withColumnsRenamed({"x": "dx", "h": "dh", "s": "ds"}).join(items, ["k", "w"])
    # one item value stands for one text value throughout the slots, both ways
    held = F.filter(F.arrays_zip(F.col("dh").alias("a"), F.col("h").alias("b"), F.col("s").alias("s")), lambda v: v["s"])
    pairs = F.array_distinct(F.transform(held, lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"))))
    both = (F.size(F.array_distinct(F.transform(pairs, lambda v: v["a"]))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(pairs, lambda v: v["b"]))) == F.size(pairs))
    return j.where("dx <> x").where(both).select("doc_id", "item_id").distinct()
