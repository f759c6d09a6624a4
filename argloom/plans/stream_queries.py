"""Queries of streams over slices of the events, and of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from argloom.operators.iterate import shared_folder
from argloom.plans.bindings import query, table
from argloom.streaming import events as S


def _checkpoint(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _stream(spark, d):
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(8, "event_id").write.parquet(at := _checkpoint(spark))
    return S.read_events(spark, at)


@query("str02_context_stamp", "SELECT event_id, 'run-1' AS run_id, 'ingest' AS phase FROM events")
def _(spark, d):
    return S.stamped(table(spark, d, "events"), "run-1", "ingest").select("event_id", "run_id", "phase")


@query("str04_replay", "WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_id, seq FROM s QUALIFY seq > greatest(5, max(seq) OVER (PARTITION BY user_id) - 40)")
def _(spark, d):
    from pyspark.sql import Window

    numbered = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"))
    return S.replay(numbered, 5, 40)


@query("str06_running_metrics", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_accepted FROM events GROUP BY 1")
def _(spark, d):
    name = f"metrics_{uuid.uuid4().hex}"
    S.run_to_table(S.running_metrics(_stream(spark, d)), name, _checkpoint(spark))
    return spark.table(name)


@query("str03_ring_buffer", "SELECT user_id, count(*) AS n, count(*) AS last_seq FROM events GROUP BY user_id")
def _(spark, d):
    S.run_to_files(S.ring_buffer(_stream(spark, d)), path := _checkpoint(spark), _checkpoint(spark))
    return spark.read.parquet(path).groupBy("user_id").agg(F.count_distinct("event_id").alias("n"), F.max("seq").alias("last_seq"))


@query("str08_checkpointed_batches", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events")
def _(spark, d):
    path = _checkpoint(spark)
    S.run_upserts(_stream(spark, d), path, _checkpoint(spark), "event_id")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"))


@query("str10_event_names", "SELECT 'event.' || lower(event_type) AS name, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return S.mapped(table(spark, d, "events")).groupBy("name", "severity").agg(F.count("*").alias("n"))


@query("ext_windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    found = S.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
