"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in that of spark.checkpoint.dir; in a temporary one only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    return f"{context.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Written once as Parquet in the shared folder, for what is large and read several times."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_few(df: DataFrame, most: int) -> DataFrame:
    """Marked to be sent to every task if it has at most so many rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of a task where the number of tasks follows from a count.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by ``keys`` into tasks of some TASK_ROWS of its ``rows`` rows, if it has more than one's.

    The session's partitions don't grow with the rows, and adaptive execution joins those whose
    bytes compress well, whatever their rows need in memory.
    """
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()
