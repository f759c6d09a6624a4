"""How the given tables stand in for graphs, runs, snapshots and predictions, in Spark and in SQL.

``@query(name, sql)`` registers a function ``(spark, sf_dir) -> DataFrame`` with the SQL of the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argloom.operators.iterate import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_and_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items and orders, both dealt out by the order's key."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.count()
    return dealt(line, rows, "l_orderkey"), dealt(orders, rows, "o_orderkey")


#: Signed, typed relations from suppliers to customers, one per line item.
EDGES_SQL = """e AS (
  SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS source, 'c' || o_custkey AS target,
         CASE l_returnflag WHEN 'R' THEN 'attacks' WHEN 'A' THEN 'supports' ELSE 'explains' END AS relation,
         CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS polarity,
         l_discount * 10 AS weight, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 50 END AS confidence,
         year(l_shipdate) AS epoch
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = lines_and_orders(spark, sf_dir)
    flag = F.col("l_returnflag")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("s"), "l_suppkey").alias("source"),
        F.concat(F.lit("c"), "o_custkey").alias("target"),
        F.when(flag == "R", "attacks").when(flag == "A", "supports").otherwise("explains").alias("relation"),
        F.when(flag == "R", -1).otherwise(1).alias("polarity"),
        (F.col("l_discount") * 10).alias("weight"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 50).alias("confidence"),
        F.year("l_shipdate").alias("epoch"),
    )


#: Suppliers and customers as nodes with a type, a layer and a prior.
NODES_SQL = """n AS (
  SELECT 's' || s_suppkey AS node_id, s_name AS name, 'evidence' AS node_type, 'L2' AS layer, s_nationkey AS nation,
         least(1.0, greatest(0.0, s_acctbal / 10000)) AS prior FROM supplier
  UNION ALL
  SELECT 'c' || c_custkey, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'hypothesis' WHEN 'MACHINERY' THEN 'axiom' ELSE 'claim' END,
         'L3', c_nationkey, least(1.0, greatest(0.0, c_acctbal / 10000)) FROM customer)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / 10000))
    segment = F.col("c_mktsegment")
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.lit("evidence").alias("node_type"), F.lit("L2").alias("layer"), F.col("s_nationkey").alias("nation"), unit("s_acctbal").alias("prior"))
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("node_id"),
        F.col("c_name").alias("name"),
        F.when(segment == "BUILDING", "hypothesis").when(segment == "MACHINERY", "axiom").otherwise("claim").alias("node_type"),
        F.lit("L3").alias("layer"),
        F.col("c_nationkey").alias("nation"),
        unit("c_acctbal").alias("prior"),
    )
    return suppliers.unionByName(customers)


#: Trade between suppliers, from all line items: a supplier's customers count for the supplier that serves them (the
#: customer's key modulo the number of suppliers), and of each supplier's relations the ``k`` heaviest are edges.  A
#: weighted digraph that grows with the tables and has cycles, chains and hubs.
TRADE_SQL = """flow AS (
  SELECT l_suppkey AS source, o_custkey % (SELECT count(*) FROM supplier) + 1 AS target, sum(l_extendedprice * (1 - l_discount)) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_suppkey <> o_custkey % (SELECT count(*) FROM supplier) + 1 GROUP BY 1, 2),
t AS (SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS place FROM flow) WHERE place <= {k})"""


def trade(spark: SparkSession, sf_dir: str, k: int | None = 3) -> DataFrame:
    """``source, target, weight``; with ``k`` None all relations are edges."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    count = table(spark, sf_dir, "supplier").agg(F.count("*").alias("_n"))
    flow = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(F.broadcast(count), F.lit(True))
        .select(F.col("l_suppkey").alias("source"), (F.col("o_custkey") % F.col("_n") + 1).alias("target"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("weight"))
        .filter("source <> target")
        .groupBy("source", "target")
        .agg(F.sum("weight").alias("weight"))
    )
    if k is None:
        return flow
    heaviest = Window.partitionBy("source").orderBy(F.desc("weight"), "target")
    return flow.withColumn("_place", F.row_number().over(heaviest)).filter(F.col("_place") <= k).drop("_place")


#: Snapshots of a research programme: one epoch per ISO week of events.
SNAPSHOTS_SQL = """snap AS (
  SELECT DISTINCT week(ts) AS epoch, CASE event_type WHEN 'signup' THEN 'core' WHEN 'click' THEN 'auxiliary' WHEN 'error' THEN 'anomaly' ELSE 'empirical' END AS kind,
         user_id * 100 + CAST(props->>'$.k' AS BIGINT) AS item FROM events)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.weekofyear("ts").cast("bigint").alias("epoch"),
            F.when(kind == "signup", "core").when(kind == "click", "auxiliary").when(kind == "error", "anomaly").otherwise("empirical").alias("kind"),
            (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("bigint")).alias("item"),
        )
        .distinct()
    )


#: Predictions with a confidence and a binary label.
PREDICTIONS_SQL = """pred AS (
  SELECT d.doc_id, lang, source, least(1.0, n_chars / 4000) AS confidence, quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("confidence"), F.col("quality").alias("label"))
