"""Sinks: nested trace corpora, JSON lines, tagged text, resumable append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import TraceState

TRACE = "trace_id long, entities array<struct<eid:string,concept:string,etype:string>>, relations array<struct<relation:string,a0:string,a1:string>>, events array<struct<pos:int,event_id:string,action:string>>, prose string"


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; letters outside ASCII stay as they are."""
    df.write.mode(mode).json(path)


def tagged_text(parts: dict[str, DataFrame], path: str) -> None:
    """Text rows of several kinds, one folder for each ``source``."""
    out = None
    for name, df in parts.items():
        d = df.select("text").withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d)
    out.write.partitionBy("source").parquet(path)


def conversations(parts: dict[str, DataFrame], path: str, caps: dict[str, int] | None = None, key: str = "id") -> None:
    """Conversations of several generators as JSON lines, each with its ``kind``; a cap of a
    generator keeps the rows of its smallest hashes."""
    out = None
    for name, df in parts.items():
        d = df
        if caps and name in caps:
            d = d.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(caps[name])
        d = d.select(F.col(key).cast("string").alias("id"), "messages").withColumn("kind", F.lit(name))
        out = d if out is None else out.unionByName(d)
    out.write.json(path)


def trace_corpus(state: TraceState, prose: DataFrame, path: str) -> None:
    """One nested record for each trace."""
    pick = lambda df, *cols: df.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_x"))
    e = pick(state.entities, "eid", "concept", "etype").withColumnRenamed("_x", "entities")
    r = pick(state.relations, "relation", "a0", "a1").withColumnRenamed("_x", "relations")
    v = pick(state.events, "pos", "event_id", "action").withColumnRenamed("_x", "events")
    out = e.join(r, "trace_id", "left").join(v, "trace_id", "left").join(prose.withColumnRenamed("text", "prose"), "trace_id", "left")
    out.write.json(path)


def read_trace_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the target does not hold yet (an interrupted run resumes)."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    new = df.dropDuplicates([key])
    if fs.exists(target):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)


def merge_small(df: DataFrame, path: str, key: str) -> None:
    """Upsert into a small table of results (read, replace by key, write beside, swap).

    The old table is moved aside, never deleted before the new one stands; a run that was
    broken off between the two moves is mended by the next one."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "_next")
    before = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "_before")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(before):
        if not fs.exists(target):
            fs.rename(before, target)
        fs.delete(before, True)
    out = df.dropDuplicates([key])
    if fs.exists(target):
        old = spark.read.parquet(path)
        out = out.unionByName(old.join(out.select(key), key, "left_anti"), allowMissingColumns=True)
    out.write.mode("overwrite").parquet(str(fresh))
    if fs.exists(target):
        fs.rename(target, before)
    fs.rename(fresh, target)
    fs.delete(before, True)
