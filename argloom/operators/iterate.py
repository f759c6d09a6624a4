"""What operators share: a durable cut of the plan between rounds, and tasks of bounded size."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task of :func:`dealt`, and the number of tasks up to which a table is left to the optimizer.
TASK_ROWS, FEW = 1 << 19, 8
#: Rows of a few short columns that a join may send to all tasks.
SENT_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str, most: int = TASK_ROWS) -> DataFrame:
    """``df`` of about ``rows`` rows, dealt out by its keys to so many tasks that each has about ``most``; a small one stays as it is.

    Left alone, Spark fills a task up to a number of shuffled bytes.  Keys in order compress to a few bits, so that one task
    would sort tens of millions of rows.  Both sides of a join take the ``rows`` of the larger one.
    """
    tasks = -(-rows // most)
    return df.repartition(tasks, *keys) if tasks > FEW else df


def sent_if_few(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``df``, stored, of short rows: sent whole to every task of a join if it has at most ``most`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where that is unset, a local session (as in tests) takes a temporary folder; on a cluster it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="argloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from what is read there, so plans stay short and a lost executor costs one round.

    A written table is used and not a checkpoint, because a checkpoint keeps the constraints that the optimizer has
    inferred: over rounds of joins they multiply until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
