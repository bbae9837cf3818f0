"""Parallelism of costly per-row stages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Kinds of plan nodes beyond which rows are shuffled already (asking those for their partitions would run them).
_SHUFFLES = ("Join", "Aggregate", "Window", "Sort", "Exchange", "Limit", "CartesianProduct", "TakeOrdered")


def _nodes(plan) -> Iterator[str]:
    """Names of the nodes of a physical plan."""
    yield plan.nodeName()
    kids = plan.children()
    for i in range(kids.size()):
        yield from _nodes(kids.apply(i))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a plain scan has fewer splits than there are cores.

    Inputs of many splits (any large table) come back unchanged, without a shuffle; so do
    plans that shuffle already and streams.
    """
    if df.isStreaming:
        return df
    run = df._jdf.queryExecution()
    if any(kind in name for name in _nodes(run.sparkPlan()) for kind in _SHUFFLES):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if run.toRdd().getNumPartitions() >= cores else df.repartition(cores)
