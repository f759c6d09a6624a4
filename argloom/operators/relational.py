"""Filters, joins, aggregates and set operations over nodes, edges, runs and key tables.

Conventions: ``nodes(node_id, ...)``, ``edges(source, target, ...)``.  A null confidence passes a threshold
wherever a filter says so.  Nothing here collects rows; small dimension tables are left to Spark's own broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.operators.iterate import cut


def at_least(column: str, threshold: float) -> Column:
    """A threshold that null passes."""
    return F.col(column).isNull() | (F.col(column) >= threshold)


def with_properties(df: DataFrame, **wanted) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in wanted.items()), F.lit(True)))


def name_search(nodes: DataFrame, text: str) -> DataFrame:
    """Case-insensitive containment either way."""
    name = F.lower("name")
    return nodes.filter(name.contains(text.lower()) | F.lit(text.lower()).contains(name))


def missing_keys(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not among the processed ones."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def named_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their ends; an unknown end keeps its id as name."""
    names = nodes.select("node_id", "name")
    out = edges
    for end in ("source", "target"):
        out = out.join(names.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return out


def dangling_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends that no node has, with the number of edges that name them."""
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id")))
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("n_edges"))


def gate(edges: DataFrame, accuracy: float, confidence: float) -> DataFrame:
    """Marks edges that a hard gate prunes: below a threshold that is above 0, null passing."""
    pruned = F.lit(False)
    for column, least in (("weight", accuracy), ("confidence", confidence)):
        if least > 0:
            pruned = pruned | F.coalesce(F.col(column) < least, F.lit(False))
    return edges.withColumn("pruned", pruned).withColumn("gated_weight", F.when(pruned, 0.0).otherwise(F.col("weight")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- plus out-degree of every node; a self loop counts twice, a node without edges has 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    found = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(found, "node_id", "left").na.fill(0, ["degree"])


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.join(F.broadcast(m), F.lit(True)).withColumn("density", F.when(possible > 0, F.col("n_edges") / possible).otherwise(0.0))


def parallel_sum(edges: DataFrame) -> DataFrame:
    """Parallel edges as one undirected edge with the sum of confidences (null counts as 1)."""
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(F.coalesce("confidence", F.lit(1.0))).alias("weight"))


def energies(edges: DataFrame, strength: DataFrame) -> DataFrame:
    """Support and attack energy of each target: the sources' strengths times edge weights, by sign."""
    flow = edges.join(strength.select(F.col("node_id").alias("source"), "strength"), "source").withColumn("_flow", F.col("strength") * F.col("weight"))
    total = lambda sign: F.coalesce(F.sum(F.when(F.col("polarity") == sign, F.col("_flow"))), F.lit(0.0))
    return flow.groupBy("target").agg(total(1).alias("support"), total(-1).alias("attack"))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def node_diff(a: DataFrame, b: DataFrame, key: str = "node_id") -> DataFrame:
    """Retained, gained and lost keys between two runs."""
    both = a.select(key, F.lit(True).alias("_a")).join(b.select(key, F.lit(True).alias("_b")), key, "full_outer")
    return both.select(key, F.when(F.col("_a").isNull(), "gained").when(F.col("_b").isNull(), "lost").otherwise("retained").alias("status"))


def edge_diff(a: DataFrame, b: DataFrame, shift: float = 0.15) -> DataFrame:
    """Edges by their ends: gained, lost, inverted (signs differ), weight_shifted (by ``shift`` or more) or retained."""
    left = a.select("source", "target", F.col("weight").alias("weight_a"), F.col("polarity").alias("polarity_a"))
    right = b.select("source", "target", F.col("weight").alias("weight_b"), F.col("polarity").alias("polarity_b"))
    both = left.join(right, ["source", "target"], "full_outer")
    status = (
        F.when(F.col("weight_a").isNull(), "gained")
        .when(F.col("weight_b").isNull(), "lost")
        .when(F.col("polarity_a") * F.col("polarity_b") < 0, "inverted")
        .when(F.abs(F.col("weight_b") - F.col("weight_a")) >= shift, "weight_shifted")
        .otherwise("retained")
    )
    return both.withColumn("status", status)


def compare_metrics(a: DataFrame, b: DataFrame, key: str = "metric") -> DataFrame:
    """Values of two runs over the union of names, a missing one as 0, with the winner by the metric's direction."""
    both = a.select(key, F.col("value").alias("value_a")).join(b.select(key, F.col("value").alias("value_b")), key, "full_outer").na.fill(0.0, ["value_a", "value_b"])
    lower = F.lower(key).rlike("cost|latency|error|duration|ece|brier|rdf|omission|hallucination")
    delta = F.col("value_b") - F.col("value_a")
    return both.withColumn("delta", delta).withColumn("winner", F.when(delta == 0, "tie").when((delta > 0) != lower, "b").otherwise("a"))


def prf(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of key sets, over all or per group; both empty gives 1."""
    by = by or []
    p = predicted.select(*by, *(k for k in keys if k not in by)).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*by, *(k for k in keys if k not in by)).distinct().withColumn("_g", F.lit(1))
    on = list(dict.fromkeys([*by, *keys]))
    both = p.join(g, on, "full_outer")
    total = both.groupBy(*by).agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("matched"),
        F.count_if(F.col("_p").isNull()).alias("omitted"),
        F.count_if(F.col("_g").isNull()).alias("spurious"),
    )
    m, o, s = F.col("matched"), F.col("omitted"), F.col("spurious")
    ratio = lambda a, b: F.when(a + o + s == 0, 1.0).when(b > 0, a / b).otherwise(0.0)
    return total.withColumn("precision", ratio(m, m + s)).withColumn("recall", ratio(m, m + o)).withColumn("f1", F.when(m + o + s == 0, 1.0).otherwise(2 * m / (2 * m + o + s)))


def upsert(current: DataFrame, incoming: DataFrame, key: str, create_only: list[str]) -> DataFrame:
    """Incoming values win, but ``create_only`` columns keep what is there already."""
    names = [c for c in current.columns if c != key]
    old = current.select(key, *(F.col(c).alias(f"_old_{c}") for c in names), F.lit(True).alias("_there"))
    both = old.join(incoming.select(key, *names, F.lit(True).alias("_new")), key, "full_outer")
    pick = lambda c: F.when(F.col("_there") & F.col("_new").isNull(), F.col(f"_old_{c}")).otherwise(F.coalesce(f"_old_{c}", c) if c in create_only else F.col(c)).alias(c)
    return both.select(key, *(pick(c) for c in names))


def gate_decision(score: Column, key: Column, accept: float, reject: float, audit: str = "01") -> Column:
    """``accept``, ``verify`` or ``reject`` by score; of the rejected, those whose hash begins with a digit of ``audit`` are audited."""
    drawn = F.substring(F.md5(key), 1, 1).isin(*audit)
    return F.when(score >= accept, "accept").when((score < reject) & drawn, "audit").when(score < reject, "reject").otherwise("verify")


def ranked(df: DataFrame, column: str, partitions: int) -> DataFrame:
    """``df`` with ``place``, its rank by ``column`` (highest first, ties share a place), without bringing all rows into one task.

    Ranges of the column are partitions; the rows of earlier ranges are added to the rank within one's own.
    """
    dealt = cut(df.repartitionByRange(partitions, F.desc(column)).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.rank().over(Window.partitionBy("_range").orderBy(F.desc(column)))
    return dealt.join(F.broadcast(before), "_range").withColumn("place", (within + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_range", "_n", "_before")
