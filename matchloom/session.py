"""Session helpers."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: The bound of an Arrow batch and what it is here, instead of Spark's 64 MB, which 10,000 rows of text come near to: what a Python worker
#: and the executor's buffers hold then goes neither by the rows of a task nor by the length of its texts, but for one longer text.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def make_visible(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed: they get its folder in PYTHONPATH, and texts in small batches."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get(BATCH, None) is None:  # else the session's owner has chosen
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, as in tests or on a laptop, may name none: a folder under its warehouse is used
    then. On a cluster that could be a folder of one machine, so it is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.shared"
    return set_dir.rstrip("/")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint; executors may be lost afterwards."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
