"""Session-wide helpers: reading tables and cutting lineage on shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a scale directory (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local does this set a temporary folder; a cluster without the setting is an error, as a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="turnloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
