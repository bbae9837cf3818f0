"""Structured Streaming forms: current state, windows, idempotent append, keyed memo.

Each runner reads a folder as a stream with ``availableNow``, writes to the folder that all
executors share and gives the written table back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="velkora-stream-")
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A parquet file or folder as a stream with the schema of its files."""
    static = spark.read.parquet(path)
    first = static.inputFiles()[0]
    folder, file = first.rsplit("/", 1)
    glob = file if path.rstrip("/").endswith(f"/{file}") else "*.parquet"
    return spark.readStream.schema(static.schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run to the end of the input; the rows of the last (complete) or of all (append) batches.

    A batch has a folder of its own by its id, so one that is run again after a failure
    replaces what it wrote before."""
    spark = stream.sparkSession
    base = shared_folder(spark)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/{number:012d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def current_values(stream: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Latest value of each key, kept up to date as events arrive."""
    return stream.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def windows(stream: DataFrame, ts: str, size: str, by: list[str], slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by tumbling or sliding window; rows later than the watermark are dropped."""
    # event time must be a zoned timestamp; the result has the zone-less one of the input
    kind = dict(stream.dtypes)[ts]
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").cast(kind).alias("start"), *by, "n")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str]) -> DataFrame:
    g = df.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), *by, "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent append: one row for each content key."""
    return stream.dropDuplicates(keys)


def fired_once(stream: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item) pairs the first time they are seen: each pair is a state entry of its own,
    so a key may fire any number of items and a batch writes only what is new."""
    return stream.where(F.col(item).isNotNull()).select(key, item).dropDuplicates([key, item])
