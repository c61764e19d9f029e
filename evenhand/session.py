"""Shared-folder helpers: everything that must outlive an executor goes there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the cluster for checkpoints.

    A machine-local folder is used only for a local master without the setting,
    which is the situation of unit tests.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="evenhand-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def new_work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several outputs share one expensive intermediate: the written
    table survives lost executors, is column-pruned on re-read and cuts lineage.
    """
    path = new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of a table; aggregates count as large as their input."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes, -1 if broadcasting is off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b").strip().lower()
    units = {"b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}
    digits = text.rstrip("bkmg")
    return int(digits) * units.get(text[len(digits):] or "b", 1)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Let the planner know the true size of a derived table before wide rows are joined with it.

    The planner takes an aggregate to be as large as its input, so a join of all
    rows with a table of a few classes would first shuffle all rows on a few keys.
    Unless the estimate already allows a broadcast, the table is written to the
    shared folder: its file size then decides, broadcast if small and shuffle if
    not, without any hint.
    """
    if planned_bytes(df) <= broadcast_limit(df.sparkSession):
        return df
    return reliable_checkpoint(df, name)
