"""Cutting lineage at a reliable checkpoint."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, or ``spark.checkpoint.dir``. Where there is neither, one of our own if all runs on one machine, as in tests; else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="coffer-checkpoint-"))
    return context.getCheckpointDir()
