"""Queries of readers and stores: files are derived from the tables, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.operators import graph as G
from argloom.operators import records as P
from argloom.operators.iterate import shared_folder
from argloom.plans.bindings import EDGES_SQL, NODES_SQL, edges, nodes, query, table
from argloom.sources import documents as S


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("src02_plain_texts", "SELECT count(*) AS n, sum(length(regexp_replace(v, '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars FROM (SELECT replace(text, chr(10), ' ') AS v FROM benchmark) WHERE length(v) > 0")
def _(spark, d):
    path = fresh(spark, "texts")
    one_line = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    table(spark, d, "benchmark").select(one_line.alias("value"), "item_id").repartition("item_id").write.partitionBy("item_id").text(path)
    return S.read_texts(spark, path).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


ARTIFACTS_SQL = "art AS (SELECT o_custkey % 5 AS run_id, o_orderpriority AS kind, o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS payload FROM orders)"


def artifacts(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("run_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("string").alias("payload"))


@query("src06_artifact_store", f"WITH {ARTIFACTS_SQL} SELECT id, payload FROM art WHERE run_id = 3 AND kind = '2-HIGH'")
def _(spark, d):
    path = fresh(spark, "artifacts")
    S.write_artifacts(artifacts(spark, d), path)
    return S.read_artifacts(spark, path, "3", "2-HIGH").select("id", "payload")


@query("src08_latest_manifests", "SELECT user_id AS run_id, max(event_id) AS created_at, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def _(spark, d):
    path = fresh(spark, "manifests")
    table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("created_at"), F.col("event_type").alias("status")).write.json(path)
    return S.latest_manifest(spark.read.schema("run_id bigint, created_at bigint, status string").json(path)).select("run_id", "created_at", "status")


@query("src09_tolerant_records", "SELECT user_id % 7 AS kind, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def _(spark, d):
    path = fresh(spark, "records")
    line = F.to_json(F.struct("event_id", "user_id"))
    table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return S.read_json_tolerant(spark, path, "event_id bigint, user_id bigint").groupBy((F.col("user_id") % 7).alias("kind")).agg(F.count("*").alias("n"))


@query("src10_first_root_wins", f"WITH {ARTIFACTS_SQL} SELECT run_id, CASE WHEN run_id < 3 THEN 'first' ELSE 'second' END AS root, count(*) AS n FROM art WHERE run_id < 3 OR run_id >= 3 GROUP BY 1, 2")
def _(spark, d):
    roots = [fresh(spark, "root") for _ in range(2)]
    S.write_artifacts(artifacts(spark, d).filter("run_id < 3"), roots[0])
    S.write_artifacts(artifacts(spark, d), roots[1])
    found = S.first_root_wins([S.read_artifacts(spark, r).withColumn("root", F.lit(name)) for r, name in zip(roots, ("first", "second"), strict=True)])
    return found.groupBy(F.col("run_id").cast("bigint").alias("run_id"), "root").agg(F.count("*").alias("n"))


@query("src17_interchange", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'nodes' AS part, count(*) AS n, round(sum(prior), 4) AS total FROM n UNION ALL SELECT 'edges', count(*), round(sum(weight), 4) FROM e")
def _(spark, d):
    path = fresh(spark, "graph")
    n, e = nodes(spark, d), edges(spark, d)
    P.write_graph(n, e, path)
    n, e = P.read_graph(spark, path, n.schema, e.schema)
    part = lambda df, name, column: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.round(F.sum(column), 4).alias("total"))
    return part(n, "nodes", "prior").unionByName(part(e, "edges", "weight"))


@query("src20_response_cache", "SELECT user_id % 2 = 0 AS hit, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def _(spark, d):
    requests = table(spark, d, "events").select("user_id", "event_type").distinct()
    cache = requests.filter("user_id % 2 = 0").select(F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("key"), F.lit("answer").alias("response"))
    path = fresh(spark, "cache")
    cache.write.parquet(path)
    hit, missed = S.cached_responses(requests, spark.read.parquet(path))
    return hit.select(F.lit(True).alias("hit")).unionByName(missed.select(F.lit(False).alias("hit"))).groupBy("hit").agg(F.count("*").alias("n"))


@query("src21_observations", "SELECT event_id % 900 AS id, max(ts) AS start_time, coalesce(arg_max(CAST(floor(value) AS BIGINT), (ts, event_id)), 0) AS tokens FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").groupBy((F.col("event_id") % 900).alias("id"), F.col("ts").cast("timestamp").alias("start_time")).agg(F.max_by("value", "event_id").alias("value"))
    tokens, none = F.floor("value").cast("bigint"), F.lit(None)
    given = e.select("id", "start_time", F.col("start_time").alias("end_time"), none.cast("double").alias("latency"), tokens.alias("tokens"), none.cast("bigint").alias("input_tokens"), none.cast("bigint").alias("output_tokens"), none.cast("double").alias("cost"))
    return S.observations(given).select("id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "tokens")


@query("src19_event_sink", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, d):
    """Events added to a sink of JSON lines in two batches, and read back."""
    path, e = fresh(spark, "events"), table(spark, d, "events").select("event_id", "user_id", "event_type")
    middle = e.agg(F.avg("event_id").alias("m")).first()["m"] or 0
    S.append_events(e.filter(F.col("event_id") < middle), path)
    S.append_events(e.filter(F.col("event_id") >= middle), path)
    back = spark.read.schema("event_id bigint, user_id bigint, event_type string").json(path)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("user_id").alias("users"))


@query("src23_graphml", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT 'node' AS kind, node_id AS source, '' AS target, name AS label FROM n UNION ALL SELECT DISTINCT 'edge', source, target, relation FROM e")
def _(spark, d):
    """The graph written as GraphML by all tasks, and read back."""
    path = fresh(spark, "graphml")
    S.write_graphml(nodes(spark, d).select("node_id", "name"), edges(spark, d).select("source", "target", "relation").distinct(), path)
    n, e = S.read_graphml(spark, path)
    return n.select(F.lit("node").alias("kind"), F.col("node_id").alias("source"), F.lit("").alias("target"), F.col("name").alias("label")).unionByName(e.select(F.lit("edge").alias("kind"), "source", "target", F.col("relation").alias("label")))


@query(
    "scl26_leaf_fingerprints",
    "WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS i, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s FROM lineitem)"
    " SELECT id, 'lines[' || i || '].number' AS path, sha256(n::VARCHAR) AS fingerprint FROM l UNION ALL SELECT id, 'lines[' || i || '].tags[0]', sha256('\"' || f || '\"') FROM l UNION ALL SELECT id, 'lines[' || i || '].tags[1]', sha256('\"' || s || '\"') FROM l"
    " UNION ALL SELECT o_orderkey, 'status', sha256('\"' || o_orderstatus || '\"') FROM orders UNION ALL SELECT o_orderkey, 'notes', sha256('[]') FROM orders UNION ALL SELECT o_orderkey, 'lines', sha256('[]') FROM orders WHERE o_orderkey NOT IN (SELECT id FROM l)",
)
def _(spark, d):
    """Orders with their lines as nested JSON, parsed without a schema, down to the leaves."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.array("l_returnflag", "l_linestatus").alias("tags"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    none = F.array().cast("array<string>")
    whole = F.struct(F.col("o_orderstatus").alias("status"), none.alias("notes"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"))
    return P.leaf_fingerprints(o.select(F.col("o_orderkey").alias("id"), F.parse_json(F.to_json(whole)).alias("v")))
