"""Conversation, answer and arithmetic text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import uniform


def continuation_split(c: Column) -> Column:
    """struct(head, tail): the first sentence where it is at most 70 % of the text and 20
    characters or more are left, else null."""
    head = F.regexp_extract(c, r"(?s)^(.*?[.!?])\s", 1)
    tail = F.trim(F.substring(c, F.length(head) + 1, F.length(c)))
    ok = (F.length(head) > 0) & (F.length(head) <= 0.7 * F.length(c)) & (F.length(tail) >= 20)
    return F.when(ok, F.struct(head.alias("head"), tail.alias("tail")))


def clean_markers(c: Column) -> Column:
    """Calculator marks ``<<…>>`` removed."""
    return F.regexp_replace(c, "<<[^>]*>>", "")


def answered(reply: Column, answers: Column) -> Column:
    """Does the reply hold one of the answers as whole words, case ignored?"""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(reply), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.exists(answers, lambda a: F.contains(low, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(a), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))))


def quote_styles(c: Column, speaker: Column, style: Column) -> Column:
    """Direct speech in one of three conventions."""
    return F.when(style == 0, F.concat(F.lit("„"), c, F.lit("“, diris "), speaker, F.lit("."))).when(style == 1, F.concat(F.lit("– "), c, F.lit(" – diris "), speaker, F.lit("."))).otherwise(F.concat(F.lit("“"), c, F.lit("” diris "), speaker, F.lit(".")))


def arithmetic(ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, kind, a, b, question, steps, answer): worked sums from hashes of ids.

    Addition and multiplication are decomposed by place value; subtraction and division
    are made from them so that results are whole.
    """
    draw = lambda name, lo, hi: (F.floor(uniform(F.col(key), name) * (hi - lo + 1)) + lo).cast("int")
    d = ids.select(key, draw("kind", 0, 3).alias("k"), draw("a", 11, 99).alias("x"), draw("b", 2, 99).alias("y"))
    kind = F.get(F.array(F.lit("add"), F.lit("sub"), F.lit("mul"), F.lit("div")), F.col("k"))
    a = F.when(F.col("k") == 1, F.col("x") + F.col("y")).when(F.col("k") == 3, F.col("x") * F.col("y")).otherwise(F.col("x"))
    d = d.withColumn("kind", kind).withColumn("a", a).withColumn("b", F.col("y"))
    tens, ones = F.floor(F.col("b") / 10).cast("int") * 10, F.col("b") % 10
    answer = F.when(F.col("k") == 0, F.col("a") + F.col("b")).when(F.col("k") == 1, F.col("a") - F.col("b")).when(F.col("k") == 2, F.col("a") * F.col("b")).otherwise(F.col("x"))
    sign = F.get(F.array(F.lit("+"), F.lit("-"), F.lit("*"), F.lit("/")), F.col("k"))
    num = lambda c: c.cast("string")
    steps = (
        F.when(F.col("k") == 0, F.concat_ws("; ", F.concat_ws(" + ", num(F.col("a")), F.concat(num(tens), F.lit(" = "), num(F.col("a") + tens))), F.concat_ws(" + ", num(F.col("a") + tens), F.concat(num(ones), F.lit(" = "), num(answer)))))
        .when(F.col("k") == 2, F.concat_ws("; ", F.concat_ws(" * ", num(F.col("a")), F.concat(num(tens), F.lit(" = "), num(F.col("a") * tens))), F.concat_ws(" * ", num(F.col("a")), F.concat(num(ones), F.lit(" = "), num(F.col("a") * ones)))))
        .otherwise(F.concat(num(F.col("a")), F.lit(" "), sign, F.lit(" "), num(F.col("b")), F.lit(" = "), num(answer)))
    )
    q = F.concat(F.lit("Kiom estas "), num(F.col("a")), F.lit(" "), sign, F.lit(" "), num(F.col("b")), F.lit("?"))
    return d.select(key, "kind", "a", "b", q.alias("question"), steps.alias("steps"), answer.alias("answer"))


#: Rows of one compressed stream.
STREAM_ROWS = 10_000


def gzip_ratio(df: DataFrame, by: str, text: str, level: int = 9) -> DataFrame:
    """(by, raw, packed, ratio): compressed against raw bytes of each group's texts.

    A group is cut by hash into streams of about ``STREAM_ROWS`` rows (the window of the
    compressor is far smaller), so a group of any size is spread over tasks; each stream
    is compressed in order of its texts as they come and never held whole.
    """
    import zlib
    from collections.abc import Iterator

    import pandas as pd

    kind = dict(df.dtypes)[by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, raw, packed, z = None, 0, 0, None
        for b in batches:
            for k, s, t in zip(b[by], b["_s"], b[text], strict=True):
                if z is None or (k, s) != key:
                    if z is not None:
                        yield pd.DataFrame({by: [key[0]], "raw": [raw], "packed": [packed + len(z.flush())]})
                    key, raw, packed, z = (k, s), 0, 0, zlib.compressobj(level)
                data = (t or "").encode()
                raw += len(data)
                packed += len(z.compress(data))
        if z is not None:
            yield pd.DataFrame({by: [key[0]], "raw": [raw], "packed": [packed + len(z.flush())]})

    rows = df.where(F.col(by).isNotNull()).select(by, text)
    n = rows.groupBy(by).agg(F.ceil(F.count("*") / STREAM_ROWS).alias("_n"))
    salted = rows.join(n, by).select(by, F.pmod(F.xxhash64(text), F.col("_n")).alias("_s"), text)
    out = salted.repartition(by, "_s").sortWithinPartitions(by, "_s", text).mapInPandas(run, f"{by} {kind}, raw long, packed long")
    g = out.groupBy(by).agg(F.sum("raw").alias("raw"), F.sum("packed").alias("packed"))
    return g.withColumn("ratio", F.round(F.col("packed") / F.col("raw"), 4))
