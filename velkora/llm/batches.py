"""Small helpers between Spark and the numpy operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.checkpoints import saved  # noqa: F401  (the operators here take it from this module)
from ..operators.parallel import spread

#: Bytes of text that are worked on at once (bounds a Python worker's memory; one longer
#: text is still taken whole).
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of about ``budget`` bytes of text."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(text))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + budget, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_text(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size; ``fn`` returns one batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return spread(df).mapInArrow(run, schema)


def batch_of(**cols: object) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in cols.items()}
    arrays = {k: v.cast(pa.string()) if pa.types.is_large_string(v.type) else v for k, v in arrays.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def lists_of(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df
