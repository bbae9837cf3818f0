"""Lineage is cut in the folder that all executors share, never on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; the session's ``spark.checkpoint.dir`` is used where it is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="velkora-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)
