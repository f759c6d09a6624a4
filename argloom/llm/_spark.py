"""Small helpers that the operators share: tables, checkpoints, let-bindings and stage sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="argloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there, so a lost executor costs no recomputation of what lies before.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local session (as in tests) takes a
    temporary one; on a cluster, whose machines do not share such a folder, it is an error.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of texts that a Python worker is sent at a time at most.
ARROW_ROWS = 2_000


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches: ten thousand long texts at once would take both the executor and its workers hundreds of megabytes."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that may be broadcast at most.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it has no more than ``rows`` rows; else it is joined by shuffling, where adaptive execution splits hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
