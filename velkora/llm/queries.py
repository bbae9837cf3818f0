"""Queries of the training-data problems (registered by ``__spark_entry__`` if present)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, forms, garble, languages, leaks, neardup, prose, residue
from .batches import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "documents"), table(spark, d, "common_words"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.garbled_documents(table(spark, d, "documents"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.restored(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(table(spark, d, "documents"), k=3, similarity=0.5, min_words=20)
    return neardup.document_pairs(members, links)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(table(spark, d, "documents"))
    return neardup.classes(members, links)


def _looks(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {
        "documents": (table(spark, d, "documents"), "doc_id", "text"),
        "factual_qa": (table(spark, d, "factual_qa"), "item_id", "question"),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.same_look_pairs(_looks(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms.consistent_forms(_looks(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "benchmark", "item_id", "text"), table(spark, d, "factual_qa", "item_id", "question")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), *_items(spark, d))


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), *_items(spark, d), exact=False)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_scores(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
