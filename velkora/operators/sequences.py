"""Ordered work: runs, neighbours, packing, set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """``island`` numbers from 1: runs of rows with one value (gaps and islands)."""
    w = W.partitionBy(part).orderBy(*order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("long")
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def adjacent_distinct(df: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = W.partitionBy(part).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_f", first).where(F.col("_f") | ~F.col("_p").eqNullSafe(F.col(value))).drop("_p", "_f")


def set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side alone, marked 'removed' or 'added'."""
    gone = before.subtract(after).withColumn("change", F.lit("removed"))
    new = after.subtract(before).withColumn("change", F.lit("added"))
    return gone.unionByName(new)


#: Ranges of the order column over which running sums are taken in two steps.
RANGES = 64


def cuts_of(df: DataFrame, order: str, ranges: int = RANGES) -> list[float]:
    """Approximate quantiles of a numeric column, at which ``running_total`` cuts."""
    return sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01)))


def running_total(df: DataFrame, part: str, order: str, value: str, total: str, ranges: int = RANGES, cuts: list[float] | None = None) -> DataFrame:
    """``total``: the sum of ``value`` up to each row of its part, in order.

    Two steps, so that a part with a third of all rows is no single task: rows are cut into
    ranges of the (numeric) order column at approximate quantiles, the sums of the ranges --
    at most ``ranges`` rows a part -- are added up first, and each range runs on from there.
    """
    cuts = cuts_of(df, order, ranges) if cuts is None else cuts
    place = reduce(lambda a, c: a + (F.lit(float(c)) < F.col(order)).cast("int"), cuts, F.lit(0))
    return _over_ranges(df.withColumn("_range", place), [part], [order], F.col(value), total)


def _over_ranges(d: DataFrame, part: list[str], order: list[str], value: Column, total: str) -> DataFrame:
    """Running sum of ``value`` in each part, over rows that have their ``_range``.

    A range gets the sum of the ranges before it as a row that stands first, so what the rows
    carry is shuffled once and nothing is joined back."""
    d = d.withColumn("_v", value.cast("long")).withColumn("_head", F.lit(1))
    before = W.partitionBy(*part).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy(*part, "_range").agg(F.sum("_v").alias("_s"))
    heads = sums.select(*part, "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_v"), F.lit(0).alias("_head"))
    w = W.partitionBy(*part, "_range").orderBy("_head", *order).rowsBetween(W.unboundedPreceding, 0)
    out = d.unionByName(heads, allowMissingColumns=True).withColumn(total, F.sum("_v").over(w))
    return out.where("_head = 1").drop("_v", "_head", "_range")


def numbered(df: DataFrame, part: list[str], place: Column, key: str, number: str, ranges: int = RANGES) -> DataFrame:
    """``number``: the row's number from 0 in its part, in order of ``place`` -- a hash in
    (0, 1) -- and key.

    Equal ranges of a hash hold about as many rows each, so numbers are given inside ranges
    and the counts of the ranges before, at most ``ranges`` rows a part, are added."""
    d = df.withColumn("_place", place).withColumn("_range", F.floor(F.col("_place") * ranges))
    out = _over_ranges(d, part, ["_place", key], F.lit(1), number)
    return out.withColumn(number, F.col(number) - 1).drop("_place")


def block_pack(df: DataFrame, part: str, order: str, tokens: str, size: int) -> DataFrame:
    """(part, block, tokens): token lists of a partition key concatenated in order and cut
    into blocks of ``size``; the incomplete tail is dropped.

    Offsets come from a running sum over lengths (``running_total``); each document is then cut into the few
    pieces that fall into different blocks, so no list longer than a block is built.
    """
    # the lists may be costly to work out: a generator keeps the optimizer from repeating them in every use
    n = df.select(part, order, F.explode(F.array(tokens)).alias(tokens)).withColumn("_n", F.size(tokens)).where("_n > 0")
    n = running_total(n, part, order, "_n", "_to", cuts=cuts_of(df.select(order), order)).withColumn("_from", F.col("_to") - F.col("_n"))
    b0, b1 = F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size)
    cut = n.withColumn("block", F.explode(F.sequence(b0, b1)))
    lo = F.greatest(F.col("_from"), F.col("block") * size)
    hi = F.least(F.col("_to"), (F.col("block") + 1) * size)
    piece = F.slice(F.col(tokens), (lo - F.col("_from") + 1).cast("int"), (hi - lo).cast("int"))
    cut = cut.select(part, "block", lo.alias("_at"), piece.alias("_piece"))
    whole = cut.groupBy(part, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda x: x["_piece"])).alias("tokens"))
    return whole.where(F.size("tokens") == size)
