"""Corpus sources: each reader gives (text, …) rows; ``combined`` unites them with a split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import split_by_hash

SOURCES = ("wiki", "hplt_05", "hplt_06", "hplt_07", "hplt_08", "hplt_09", "gutenberg", "mc4", "sentences", "factoids", "trace_prose", "gsm8k")
#: Sources of short texts, to which no least length applies.
SHORT = ("factoids", "sentences")
BLANK = r"^[ \t\n\r]*$"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; a line that cannot be read fails the job, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def wiki(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("text")


def web_crawl(spark: SparkSession, path: str, min_score: int | None = None) -> DataFrame:
    """Crawl JSON lines: rows flagged discard and blank rows leave; files whose name starts
    with a bucket score below ``min_score`` are pruned by name before they are read."""
    df = spark.read.schema("text string, filter string").json(path)
    if min_score is not None:
        score = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).try_cast("int")
        df = df.where(score >= min_score)
    return kept(df).select("text")


def books(spark: SparkSession, path: str) -> DataFrame:
    """One file is one row."""
    return spark.read.text(path, wholetext=True).select(F.trim("value").alias("text")).where(F.length("text") > 0)


def mc4(spark: SparkSession, path: str) -> DataFrame | None:
    """None where the data set is absent or holds no text column."""
    try:
        df = spark.read.parquet(path)
    except Exception:  # noqa: BLE001  (an absent path has several error classes)
        return None
    return df.select("text") if "text" in df.columns else None


def sentence_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The third of three or more tab-separated columns, blank ones left out."""
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).where(F.size(parts) >= 3).select(F.get(parts, F.lit(2)).alias("text")).where(~F.col("text").rlike(BLANK))


def factoids(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first path that can be read; blank texts leave."""
    for p in paths:
        try:
            return spark.read.schema("text string").json(p).where("text is not null").where(~F.col("text").rlike(BLANK))
        except Exception:  # noqa: BLE001
            continue
    return None


def labelled_dump(spark: SparkSession, path: str, schema: str, lang: str = "eo") -> DataFrame:
    """Entities of a knowledge dump that have a label in a language."""
    return spark.read.schema(schema).json(path).where(F.col("labels").getItem(lang).isNotNull())


def min_length(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    return df.where(F.length(text) >= n)


def kept(df: DataFrame, text: str = "text", flag: str = "filter") -> DataFrame:
    """Rows with ink that are not flagged discard (any case)."""
    return df.where(F.col(text).isNotNull() & ~F.col(text).rlike(BLANK) & (F.coalesce(F.lower(F.col(flag)), F.lit("")) != "discard"))


def split_table(df: DataFrame, source: str = "source", min_chars: int = 0, train_percent: int = 95, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``combined`` for one table that names the source of each row: read once, whatever the sources."""
    d = df.where(F.col(text).isNotNull() & ~F.col(text).rlike(BLANK))
    if min_chars:
        d = d.where(F.coalesce(F.col(source).isin(*SHORT), F.lit(False)) | (F.length(text) >= min_chars))
    return d.withColumn("split", split_by_hash(F.col(key), train_percent))


def combined(parts: dict[str, DataFrame], min_chars: int = 0, train_percent: int = 95, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Union of the chosen sources with ``source`` and ``split``; short sources are exempt
    from the least length; choosing none is an error."""
    if not parts:
        raise ValueError("no source selected")
    out = []
    for name, df in parts.items():
        d = df.where(F.col(text).isNotNull() & ~F.col(text).rlike(BLANK))
        if min_chars and name not in SHORT:
            d = min_length(d, min_chars, text)
        out.append(d.withColumn("source", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).withColumn("split", split_by_hash(F.col(key), train_percent))
