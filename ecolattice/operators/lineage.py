"""Cutting lineage: intermediate tables that several later plans read are written once to the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and read back from a reliable checkpoint.

    Goes to spark.checkpoint.dir; where that is unset (tests) to a folder of
    our own. Plans on top stay small however many steps came before, and a lost
    executor loses nothing.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """The frame written as a Parquet table beside the checkpoints and read back: for large tables that are read often, in a third of the space."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/cells-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Lets Spark's cleaner delete shuffles that nothing needs any more, after a checkpoint."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
