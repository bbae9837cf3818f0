"""Near-duplicate texts by covering locality-sensitive hashing.

A text becomes the set of its distinct ``shingle``-word runs (one consistent form, lower
case).  The set is sketched by ``GROUPS * WIDTH`` min-hash coordinates of 16 bits; two sets
with Jaccard similarity s agree in each coordinate with probability s.  The coordinates are
cut into GROUPS blocks, a block is one long, and the bit masks of a block leave out one of
its coordinates each.  This is a covering family: two sketches that differ in at most
``RADIUS`` coordinates have, by the pigeonhole principle, a block in which at most one
coordinate differs, and so collide in the table of the mask that leaves it out -- certainly,
not just likely.  A collision of sets whose sizes or sketches cannot be those of a similar
pair is dropped on the spot; the others are checked exactly on the shingle sets.

Copies (equal shingle sets) are one class: only its representative is hashed into the
tables, so a text that fills a third of the corpus costs one row there.  What is shuffled
of a representative is a (key, id) row a table; most keys occur once and go no further, and
the short sketch follows only the rows of keys that recur.

Defined results: null, empty and blank texts and texts of fewer than ``min_words`` words
take no part; equal sets count as similarity 1; pairs are given once, smaller id first;
rows that repeat an id are one document (of different texts under one id, the one whose
set has the smallest name stands); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import codepoints as C
from .batches import batch_of, lists_of, map_text, saved

U64 = np.uint64
GROUPS, WIDTH = 24, 4
#: Most differing coordinates with which two sketches are certain to collide.
RADIUS = 2 * GROUPS - 1
#: The short sketch: so many coordinates, four bits of each, and the least of them that agree in a
#: pair that is checked exactly.  At similarity 0.5 a pair has fewer with probability 2e-5.
SHORT, LEAST_AGREEING = 64, 18
#: Bits of the map of ids whose sets are needed (8 MB, whatever the size of the input).
MAP_BITS = 1 << 26
#: Documented default of the engine; callers state their own.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = C.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    return seed[:n], seed[n:] | U64(1)


def shingle_sets(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word runs of each row, offsets, words by row."""
    c, o = C.unify(*C.decode(arr))
    c = C.lower_table()[c]
    s, e, woff = C.words(c, o)
    h = C.word_hashes(c, s, e)
    n = len(o) - 1
    pos, row = C.window_ok(woff, k)
    w = C.windows(h, k)[pos]
    order = np.lexsort((w, row))
    w, row = w[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
    w, row = w[new], row[new]
    return w, np.searchsorted(row, np.arange(n + 1)), np.diff(woff)


def sketches(w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, GROUPS) blocks and (rows, SHORT / 16) short sketches of non-empty sets, as longs."""
    n = len(off) - 1
    a, m = _coefficients(GROUPS * WIDTH)
    blocks = np.zeros((n, GROUPS), np.uint64)
    short = np.zeros((n, SHORT // 16), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GROUPS * WIDTH):
            c = C.mix(np.minimum.reduceat((w ^ a[i]) * m[i], off[:-1]))
            blocks[:, i // WIDTH] |= (c & U64(0xFFFF)) << U64(16 * (i % WIDTH))
            if i < SHORT:
                short[:, i // 16] |= (c >> U64(60)) << U64(4 * (i % 16))
    return blocks, short


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def table_keys(blocks: list[Column]) -> list[Column]:
    """Keys of all tables: a block without the coordinate its mask leaves out, whose place holds the table's number."""
    keys = []
    for g, block in enumerate(blocks):
        for j in range(WIDTH):
            mask = _signed(~(0xFFFF << 16 * j) & (2**64 - 1))
            keys.append(block.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(_signed((g * WIDTH + j) << 16 * j))))
    return keys


def _agreeing(a: list[str], b: list[str]) -> Column:
    """Number of equal four-bit places in two lists of longs, by masks and bit counts (stays in codegen)."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        d = F.col(x).bitwiseXOR(F.col(y))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x3333333333333333))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + (F.lit(16) - F.bit_count(d))
    return total


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.where("id is not null and t is not null and length(t) > 0")


def _names(w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit name of each non-empty set."""
    size = np.diff(off).astype(np.uint64)
    with np.errstate(over="ignore"):
        return C.mix(np.add.reduceat(C.mix(w), off[:-1]) ^ size), C.mix(np.add.reduceat(C.mix(w ^ U64(0xA5A5A5A5A5A5A5A5)), off[:-1]))


def _taken(w: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the rows ``keep`` alone."""
    size = np.diff(off)[keep]
    flat = np.repeat(off[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return w[flat], np.concatenate([[0], np.cumsum(size)])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_BLOCKS = [f"b{i}" for i in range(GROUPS)]
_SHORT = [f"t{i}" for i in range(SHORT // 16)]


def _sketches(src: DataFrame, k: int, min_words: int) -> DataFrame:
    """(id, s1, s2, n, b0…, t0…): name and size of the shingle set, blocks, short sketch."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w, off, n_words = shingle_sets(b.column(1), k)
        keep = np.flatnonzero((n_words >= max(min_words, k)) & (np.diff(off) > 0))
        if not len(keep):
            return None
        w, off = _taken(w, off, keep)
        s1, s2 = _names(w, off)
        blocks, short = sketches(w, off)
        cols = {c: _longs(m[:, i]) for cs, m in ((_BLOCKS, blocks), (_SHORT, short)) for i, c in enumerate(cs)}
        return batch_of(id=b.column(0).take(pa.array(keep)), s1=_longs(s1), s2=_longs(s2), n=np.diff(off).astype(np.int32), **cols)

    return map_text(src, "t", fn, "id long, s1 long, s2 long, n int, " + ", ".join(f"{c} long" for c in _BLOCKS + _SHORT))


def _id_map(ids: DataFrame) -> np.ndarray:
    """Bit map of hashed ids: a bounded filter that may keep an id too many, never one too few."""
    bit = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)) + 1  # buckets and places count from one
    maps = ids.select(F.bitmap_bucket_number(bit).alias("at"), F.bitmap_bit_position(bit).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for at, bits in maps.collect():  # at most MAP_BITS / 32768 rows of 4 KB
        out[(at - 1) * 4096 : at * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _sets(src: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(id, s1, s2, w): sorted shingle set of the rows whose id the bit map holds."""
    held = src.sparkSession.sparkContext.broadcast(wanted)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        bit = b.column(2).to_numpy()
        rows = np.flatnonzero(held.value[bit >> 3] >> (bit & 7) & 1)
        if not len(rows):
            return None
        b = b.take(pa.array(rows))
        w, off, _ = shingle_sets(b.column(1), k)
        keep = np.flatnonzero(np.diff(off) > 0)
        if not len(keep):
            return None
        w, off = _taken(w, off, keep)
        s1, s2 = _names(w, off)
        return batch_of(id=b.column(0).take(pa.array(keep)), s1=_longs(s1), s2=_longs(s2), w=lists_of(w.view(np.int64), off))

    rows = src.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)))
    return map_text(rows, "t", fn, "id long, s1 long, s2 long, w array<long>")


def near_duplicates(df: DataFrame, k: int = SHINGLE_WORDS, similarity: float = SIMILARITY, min_words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): class of each document, and similar pairs of representatives.

    ``members`` is (id, rep): documents with one shingle set share the smallest id as
    ``rep``.  ``links`` is (rep_a, rep_b, sim) with rep_a < rep_b and sim >= similarity.
    """
    src = _prepared(df, id_col, text_col)
    sk = saved(_sketches(src, k, min_words))
    names = sk.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("m")).select("id", "m.s1", "m.s2")
    reps = names.groupBy("s1", "s2").agg(F.min("id").alias("rep"))  # map-side combined: a hot set is one row a task
    named = saved(names.join(reps, ["s1", "s2"]).select("id", "rep", "s1", "s2"))
    lone = named.where("id = rep").select("id", "s1", "s2")
    own = sk.join(lone, ["id", "s1", "s2"], "left_semi")
    keys = own.select("id", F.explode(F.array(*table_keys([F.col(c) for c in _BLOCKS]))).alias("key"))
    again = keys.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1").select("key", "id")  # groups pass through in order and spill
    rows = again.join(own.select("id", "n", *_SHORT), "id")
    a = rows.select("key", F.col("id").alias("rep_a"), F.col("n").alias("na"), *[F.col(f).alias(f"a{f}") for f in _SHORT])
    b = rows.select("key", F.col("id").alias("rep_b"), F.col("n").alias("nb"), *[F.col(f).alias(f"b{f}") for f in _SHORT])
    size = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity - 1e-9)
    near = size & (_agreeing([f"a{f}" for f in _SHORT], [f"b{f}" for f in _SHORT]) >= LEAST_AGREEING)
    cand = saved(a.join(b, "key").where((F.col("rep_a") < F.col("rep_b")) & near).select("rep_a", "rep_b").distinct())
    sets = _sets(src, k, _id_map(cand.select(F.explode(F.array("rep_a", "rep_b")).alias("id"))))
    for x in "ab":
        cand = cand.join(lone.select(F.col("id").alias(f"rep_{x}"), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2")), f"rep_{x}")
    for x in "ab":
        one = sets.select(F.col("id").alias(f"rep_{x}"), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("w").alias(f"w{x}"))
        cand = cand.join(one, [f"rep_{x}", f"{x}1", f"{x}2"])
    both = F.size(F.array_intersect("wa", "wb"))
    links = cand.select("rep_a", "rep_b", (both / (F.size("wa") + F.size("wb") - both)).alias("sim"))
    return named.select("id", "rep"), links.where(F.col("sim") >= similarity).distinct()


def document_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b): the links and the copies written out for documents."""
    links = saved(links)
    ma = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    mb = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = links.select("rep_a", "rep_b").join(ma, "rep_a").join(mb, "rep_b")
    within = ma.join(mb.withColumnRenamed("rep_b", "rep_a"), "rep_a").where("x < y").withColumn("rep_b", F.col("rep_a"))
    both = across.select("x", "y").unionByName(within.select("x", "y"))
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links): one row per document."""
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    size = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    per = size.join(ends, "rep", "left").na.fill(0, ["n_links"])
    return members.join(per, "rep").select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), "n_copies", "n_links")
