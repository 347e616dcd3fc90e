"""The folder that all executors share, and reliable checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where that is unset, a fresh one of this machine if Spark runs on this
    machine alone; on a cluster, where other machines couldn't read that, an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def folder(spark: SparkSession, prefix: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{prefix}{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
