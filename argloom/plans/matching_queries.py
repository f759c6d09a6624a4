"""Queries of constraint formulas, theories that claim clusters, soft matches of labels, and small missing expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from argloom.functions import text as T
from argloom.functions.formulas import deviations
from argloom.operators.iterate import dealt
from argloom.operators.phrases import find_phrases
from argloom.operators.retrieval import soft_matches
from argloom.operators.theory import claimants
from argloom.plans.bindings import EDGES_SQL, NODES_SQL, edges, nodes, query, table
from argloom.plans.scalar_queries import EMBED_SQL

#: Laws over a supplier's numbers: the formula, and the same in SQL.  ``Missing`` is not known, the last ones are no formulas.
_LAWS = [
    ("balance - 100 * nation", "abs(b - 100 * n)"),
    ("max(balance, 0) / (nation - 3)", "abs(CASE WHEN n = 3 THEN 1 ELSE greatest(b, 0) / (n - 3) END)"),
    ("balance >= 1000", "greatest(0, 1000 - b)"),
    ("BALANCE == orders + Missing", "abs(b - k)"),
    ("sqrt(balance) * 0.5", "sqrt(greatest(0, b)) * 0.5"),
    ("min(nation, orders, 7) ** 2", "power(least(n, k, 7), 2)"),
    ("(nation - 30) ** 0.5", "1"),
    ("-abs(balance) + +nation < nation", "0"),
    ("0 ** (nation - 5)", "CASE WHEN n < 5 THEN 1 WHEN n = 5 THEN 1 ELSE 0 END"),
    ("", "0"),
    ("balance +", "1"),
    ("__import__('os').getcwd()", "1"),
    ("1 < nation < 5", "1"),
    ("min(nation)", "1"),
]


@query(
    "mth07_formulas",
    "WITH p AS (SELECT s_suppkey, s_acctbal::DOUBLE AS b, s_nationkey::DOUBLE AS n, count(l_orderkey)::DOUBLE AS k FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3), d AS ("
    + " UNION ALL ".join(f"SELECT s_suppkey, {i} AS formula_id, ({sql})::DOUBLE AS x FROM p" for i, (_, sql) in enumerate(_LAWS))
    + ") SELECT s_suppkey, formula_id, round(x, 6) AS deviation FROM d",
)
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("k"))
    rows = table(spark, d, "supplier").join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    names = F.create_map(F.lit("Balance"), F.col("s_acctbal").cast("double"), F.lit("nation"), F.col("s_nationkey").cast("double"), F.lit("orders"), F.coalesce("k", F.lit(0)).cast("double"))
    laws = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(_LAWS)], "formula_id int, formula string")
    return deviations(rows.select("s_suppkey", names.alias("parameters")), laws).withColumn("deviation", F.round("deviation", 6))


@query(
    "joi27_claimants",
    "WITH t AS (SELECT item_id, lower(text) AS name, 'chars:' || length(text) AS dim FROM benchmark) SELECT DISTINCT doc_id, item_id FROM documents d JOIN t ON contains(lower(d.text), t.name) OR t.dim = 'chars:' || d.n_chars OR d.doc_id = t.item_id",
)
def _(spark, d):
    """Documents are clusters of observations, passages are theories: a passage claims a document of its length, one that it stands in, and the one with its id."""
    docs, passages = table(spark, d, "documents"), table(spark, d, "benchmark")
    clusters = docs.select(F.col("doc_id").alias("cluster_id"), F.array(F.concat(F.lit("chars:"), "n_chars")).alias("dimensions"), "text", F.array(F.col("doc_id").cast("string")).alias("node_ids"))
    theories = passages.select(F.col("item_id").alias("theory_id"), F.col("text").alias("name"), F.array(F.concat(F.lit("Chars:"), F.length("text"))).alias("dimensions"), F.array(F.col("item_id").cast("string")).alias("node_ids"))
    return claimants(clusters, theories).select(F.col("cluster_id").alias("doc_id"), F.col("theory_id").alias("item_id"))


_LABELS = "x AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS id, p_size FROM part), texts AS (SELECT DISTINCT id, id AS text FROM x)"


@query(
    "eva13_soft_match",
    f"WITH {_LABELS}, {EMBED_SQL.format(id='id', t='texts', name='v')}, pred AS (SELECT DISTINCT id FROM x WHERE p_size <= 25), gold AS (SELECT DISTINCT id FROM x WHERE p_size > 20),"
    " s AS (SELECT a.id AS pred, b.id AS gold, round(sum(a.x * b.x), 12) AS s FROM v a JOIN v b ON a.slot = b.slot WHERE a.id IN (SELECT id FROM pred) AND b.id IN (SELECT id FROM gold) GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 12) >= 0.95)"
    " SELECT pred, gold, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY pred ORDER BY s DESC, gold) = 1",
)
def _(spark, d):
    label = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label"), "p_size")
    found = soft_matches(label.filter("p_size <= 25").select("label"), label.filter("p_size > 20").select("label"), 0.95)
    return found.select("pred", "gold", F.round("similarity", 6).alias("similarity"))


@query("joi02_endpoint_texts", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT relation, a.name AS source_text, b.name AS target_text, count(*) AS n FROM e JOIN n a ON a.node_id = source JOIN n b ON b.node_id = target GROUP BY 1, 2, 3")
def _(spark, d):
    n = nodes(spark, d)
    e = dealt(edges(spark, d).select("source", "target", "relation"), table(spark, d, "lineitem").count(), "source", "target", "relation")
    e = e.groupBy("source", "target", "relation").agg(F.count("*").alias("n"))
    for end in ("source", "target"):
        e = e.join(n.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_text")), end)
    return e.groupBy("relation", "source_text", "target_text").agg(F.sum("n").alias("n"))


@query("agg09_type_and_relation_counts", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT 'entity' AS kind, node_type AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY 2")
def _(spark, d):
    count = lambda df, kind, column: df.groupBy(F.lit(kind).alias("kind"), F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return count(nodes(spark, d), "entity", "node_type").unionByName(count(edges(spark, d), "relation", "relation"))


@query("dat02_latency", "SELECT o_orderkey, coalesce(max(date_diff('day', o_orderdate, l_shipdate)), 0)::BIGINT AS latency FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    """The time from an order to its last shipment; none without a shipment counts as 0."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end"))
    o = table(spark, d, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.date_diff("end", "o_orderdate"), F.lit(0)).cast("bigint").alias("latency"))


@query("joi27_named_in_text", "WITH h AS (SELECT item_id, doc_id, strpos(lower(d.text), lower(b.text)) AS place FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))) SELECT item_id, count(*) AS n_docs, min(place - 1)::BIGINT AS first_start FROM h GROUP BY 1")
def _(spark, d):
    """Passages looked up word for word, whatever the case, in the flat texts."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.lower("text").alias("phrase"))
    return find_phrases(docs, passages).groupBy(F.col("phrase_id").alias("item_id")).agg(F.count("*").alias("n_docs"), F.min("start").alias("first_start"))


@query("mth08_composite_similarity", "SELECT p_partkey, round(0.5 * (CASE WHEN length(p_type) >= 4 AND contains(lower(p_name), lower(p_type)) THEN 1 ELSE 0 END) + 0.3 * len(list_intersect(regexp_split_to_array(lower(p_name), ' '), regexp_split_to_array(lower(p_type), ' '))) / len(list_distinct(list_concat(regexp_split_to_array(lower(p_name), ' '), regexp_split_to_array(lower(p_type), ' ')))) + 0.2 * (1 - abs(length(p_name) - length(p_type)) / greatest(length(p_name), length(p_type), 1)), 6) AS similarity FROM part")
def _(spark, d):
    """Name overlap, shared words and likeness of length, weighted."""
    a, b = F.lower("p_name"), F.lower("p_type")
    part_of = F.when((F.length(b) >= 4) & a.contains(b), 1.0).otherwise(0.0)
    words = T.set_jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    length = 1 - F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return table(spark, d, "part").select("p_partkey", F.round(0.5 * part_of + 0.3 * words + 0.2 * length, 6).alias("similarity"))
