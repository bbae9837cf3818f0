"""Vector similarity and many-pattern containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of what is sent to every executor.
MAX_QUERY_VECTORS, MAX_PATTERNS, BLOCK = 200_000, 500_000, 4096


def cosine_topk(df: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """(a, b, cos): the k rows nearest to each query row, itself left out.

    The stated query rows, at most ``MAX_QUERY_VECTORS``, are sent out once; the table is read
    once, each Arrow batch meets them block by block in a matrix product, and a task keeps the
    k best of each query so far, so k rows a query and task leave it.  Ties go to the smaller key.
    """
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    rows = df.where(is_query & F.col(vector).isNotNull()).select(key, vector).limit(MAX_QUERY_VECTORS + 1).toPandas()
    if len(rows) > MAX_QUERY_VECTORS:
        raise ValueError(f"more than {MAX_QUERY_VECTORS} query vectors")
    q = np.stack(rows[vector].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))
    held = spark.sparkContext.broadcast((rows[key].to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)))

    def run(batches):
        ids, q = held.value
        best = np.full((len(ids), k), -np.inf)
        who = np.zeros((len(ids), k), ids.dtype)
        for b in batches:
            if not len(ids) or not len(b):
                continue
            b = b.sort_values(key, kind="stable")
            v = np.stack(b[vector].to_numpy()).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            keys = b[key].to_numpy()
            for lo in range(0, len(ids), BLOCK):
                at = slice(lo, lo + BLOCK)
                c = q[at] @ v.T
                c[ids[at, None] == keys[None, :]] = -np.inf
                top = np.argsort(-np.round(c, 9), axis=1, kind="stable")[:, :k]
                both = np.concatenate([best[at], np.take_along_axis(c, top, 1)], axis=1)
                names = np.concatenate([who[at], keys[top]], axis=1)
                order = np.lexsort((names, -np.round(both, 9)), axis=1)[:, :k]
                best[at], who[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        some = np.isfinite(best)
        yield pd.DataFrame({"a": np.repeat(ids, k).reshape(best.shape)[some], "b": who[some], "cos": best[some]})

    kind = dict(df.dtypes)[key]
    out = df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"a {kind}, b {kind}, cos double")
    w = W.partitionBy("a").orderBy(F.round("cos", 9).desc(), "b")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("a", "b", F.round("cos", 6).alias("cos"))


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: x / n)


def mean_vector(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, i, mean): average of each component."""
    p = df.select(by, F.posexplode(vector).alias("i", "x"))
    return p.groupBy(by, "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def mean_pairwise(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, mean): mean cosine over the pairs of a group, without forming pairs.

    The sum over all ordered pairs of unit vectors is the squared length of their sum, so
    one aggregation by component is enough: (|S|^2 - n) / (n (n - 1)).
    """
    p = df.select(by, F.posexplode(unit(F.col(vector))).alias("i", "x"))
    s = p.groupBy(by, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    g = s.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    return g.where("n > 1").select(by, ((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean"))


def analogy(df: DataFrame, key: str, vector: str, a: int, b: int, c: int, k: int) -> DataFrame:
    """(key, cos): rows nearest to a - b + c, the three left out."""
    v = {r[0]: r[1] for r in df.where(F.col(key).isin(a, b, c)).select(key, vector).collect()}  # three rows
    if len(v) < 3:
        return df.select(key, F.lit(0.0).alias("cos")).limit(0)
    target = F.array(*[F.lit(float(x - y + z)) for x, y, z in zip(v[a], v[b], v[c], strict=True)])
    dot = F.aggregate(F.zip_with(unit(F.col(vector)), unit(target), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.where(~F.col(key).isin(a, b, c)).select(key, dot.alias("c")).orderBy(F.round("c", 9).desc(), key).limit(k).select(key, F.round("c", 6).alias("cos"))


def containing(texts: DataFrame, text_id: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str) -> DataFrame:
    """(pattern_id, text_id): texts that contain a pattern, case ignored.

    The patterns are a bounded list; one automaton of all of them is run over each text.
    """
    import pandas as pd

    rows = patterns.select(pattern_id, F.lower(pattern)).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    by: dict[str, list] = {}
    for i, p in rows:
        by.setdefault(p, []).append(i)
    held = texts.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for p, ids in held.value.items():
            auto.add_word(p, ids)
        auto.make_automaton()
        for b in batches:
            out = [(i, d) for d, t in zip(b[text_id], b["_t"], strict=True) if t is not None and len(auto) for i in {i for _, ids in auto.iter(t) for i in ids}]
            yield pd.DataFrame(out, columns=[pattern_id, text_id])

    return texts.select(text_id, F.lower(text).alias("_t")).mapInPandas(run, f"{pattern_id} {dict(patterns.dtypes)[pattern_id]}, {text_id} {dict(texts.dtypes)[text_id]}")
