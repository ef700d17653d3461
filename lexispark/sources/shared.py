"""The folder that driver and executors share, and what is kept in it while a job runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only in local mode, where driver and executors are one process, may it be unset."""
    sc = spark.sparkContext
    held, named = sc.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return named or held
    if not named and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="lexispark-")
    sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it is not made here."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: what comes before runs once, and a lost executor costs no more than its tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
