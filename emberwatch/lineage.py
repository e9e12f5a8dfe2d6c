"""Cutting lineage through the checkpoint folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where none is named (tests)."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named is None:
        existing = spark.sparkContext.getCheckpointDir()
        named = existing or tempfile.mkdtemp(prefix="emberwatch-checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once, and an executor that is lost later
    does not cause the plan behind them to run again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """The same rows as a Parquet table of the shared folder, in a folder per value of `parts`: later plans read only
    the columns and folders they need, and losing an executor repeats a read."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/emberwatch/{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
