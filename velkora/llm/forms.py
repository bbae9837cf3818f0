"""Visually identical text: one consistent form, and the pairs that differ from it.

``consistent_form`` rewrites a text column; ``same_look_pairs`` gives the pairs of rows
that look the same but are made of different characters.

Defined results: null stays null in ``consistent_form`` and is never paired; texts that
are blank in the consistent form are never paired; exact copies are not paired with each
other; repeated ids are paired as rows with ``id_a < id_b`` only; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from .batches import batch_of, map_text, saved

U64 = np.uint64
_MULT = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def row_hash(cps: np.ndarray, off: np.ndarray, which: int) -> np.ndarray:
    """64-bit hash of each whole row (polynomial in one of two odd multipliers)."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros(n, np.uint64)
    if len(cps):
        with np.errstate(over="ignore"):
            p = np.full(int(size.max()), _MULT[which], np.uint64)
            p[0] = U64(1)
            p = np.multiply.accumulate(p)
            v = (cps.astype(np.uint64) + U64(1)) * p[np.arange(len(cps)) - np.repeat(off[:-1], size)]
            some = size > 0
            out[some] = np.add.reduceat(v, off[:-1][some])
    return C.mix(out ^ (size.astype(np.uint64) << U64(32)))


def consistent_form(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form): the one consistent form of each text."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        c, o = C.unify(*C.decode(b.column(1)))
        form = C.encode(c, o).cast(pa.string())
        if b.column(1).null_count:
            form = pa.compute.if_else(b.column(1).is_null(), pa.scalar(None, pa.string()), form)
        return batch_of(id=b.column(0), form=form)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_text(src, "t", fn, "id long, form string").select(F.col("id").alias(id_col), "form")


def consistent_forms(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(tbl, id, form) of the rows of all tables, given as in ``same_look_pairs``."""
    parts = [consistent_form(d, i, t).select(F.lit(name).alias("tbl"), F.col(i).alias("id"), "form") for name, (d, i, t) in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def _fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, roff = C.decode(b.column(1))
        c, o = C.unify(raw, roff)
        ink = np.zeros(len(c) + 1, np.int64)
        np.cumsum((c != 32) & (c != 10), out=ink[1:])
        keep = np.flatnonzero(ink[o[1:]] > ink[o[:-1]])
        f1, f2, r = row_hash(c, o, 0), row_hash(c, o, 1), row_hash(raw, roff, 1)
        take = lambda a: pa.array(a[keep].view(np.int64))
        return batch_of(id=b.column(0).take(pa.array(keep)), f1=take(f1), f2=take(f2), raw=take(r))

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    src = src.where("t is not null and id is not null")
    return map_text(src, "t", fn, "id long, f1 long, f2 long, raw long")


def same_look_pairs(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(tbl, id_a, id_b) of rows of one table that look alike in different characters.

    ``tables`` maps a name to (frame, id column, text column).  A row shrinks to four
    longs before anything is shuffled; forms with a single spelling leave in a map-side
    combined aggregation.  Spellings of a form are paired, not rows: copies of one text never
    meet each other, and the ids join the pairs of spellings at the end, so the work is as
    large as the result.
    """
    parts = [_fingerprints(d, i, t).withColumn("tbl", F.lit(name)) for name, (d, i, t) in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = saved(rows)
    key = ["tbl", "f1", "f2"]
    mixed = rows.groupBy(*key).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*key)
    some = rows.join(mixed, key, "left_semi")
    kinds = some.select(*key, "raw").distinct()
    pairs = kinds.withColumnRenamed("raw", "raw_a").join(kinds.withColumnRenamed("raw", "raw_b"), key).where("raw_a < raw_b")
    for x in "ab":
        pairs = pairs.join(some.select(*key, F.col("raw").alias(f"raw_{x}"), F.col("id").alias(f"id_{x}")), [*key, f"raw_{x}"])
    return pairs.where("id_a <> id_b").select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
