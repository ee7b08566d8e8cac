"""Cutting lineage in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="latticeq-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage; survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of rounds that nothing refers to any more.

    It does so when the driver's garbage is collected, which many short rounds in a row do not wait for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
