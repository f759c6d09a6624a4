"""Theory graphs before and after they are solved: priors, edge weights, admission, matching against a reference, tenability.

Every operator takes DataFrames or columns of the caller's own; a null column stands for a value that was not given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.functions.scores import soft_gate, unit
from argloom.operators.phrases import find_phrases

# Parts of the weighted blends of a node's match, by what the reference node has.
NODE_BLENDS = {
    (True, True): {"axiom": 0.35, "name": 0.25, "anchor": 0.20, "type": 0.10, "status": 0.10},
    (True, False): {"axiom": 0.45, "name": 0.25, "type": 0.15, "status": 0.15},
    (False, True): {"anchor": 0.35, "name": 0.35, "type": 0.15, "status": 0.15},
    (False, False): {"name": 0.50, "type": 0.30, "status": 0.20},
}
SAME_ID = 0.85


def prior(*given: Column, default: float = 0.5) -> Column:
    """The first prior that is given, clipped to [0, 1]."""
    return unit(F.coalesce(*given, F.lit(default)))


def edge_weight(row: dict[str, Column], typed: bool) -> Column:
    """An edge's weight by the first rule that applies.

    ``row`` has columns ``effective, active, inferential, modal, stance, weight``.  A typed edge prefers its effective weight,
    a plain record its active one; a record's inferential force stands alone only where no stance probability is given.
    """
    force = F.coalesce(row["inferential"], row["modal"], F.lit(1.0)) * row["stance"]
    explicit = ("effective", "active") if typed else ("active", "effective")
    return F.greatest(F.lit(0.0), F.coalesce(*(row[c] for c in explicit), force, row["inferential"], row["weight"], F.lit(1.0)))


def with_missing_ends(nodes: DataFrame, edges: DataFrame, tau: float = 0.5) -> DataFrame:
    """``nodes(node_id, tau)`` and, at a neutral prior, every end of an edge that is not among them."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return nodes.select("node_id", "tau").unionByName(ends.join(nodes.select("node_id"), "node_id", "left_anti").withColumn("tau", F.lit(tau)))


def admitted(edges: DataFrame, accuracy: float = 0.0, stance: float = 0.0, confidence: float = 0.0, soft: bool = False, binary: bool = False, prune: bool = True) -> DataFrame:
    """Edges after the admissibility gate, with the ``weight`` that the solver uses.

    ``edges`` has ``weight, accuracy, stance, confidence``.  A threshold of 0 is off and null passes.  The hard gate prunes (or gives
    weight 0); the soft one multiplies by sigmoids of stance and confidence.  ``binary`` forgets the size of weights.
    """
    weight = F.lit(1.0) if binary else F.col("weight")
    if soft:
        gate = [F.when(F.col(c).isNotNull(), soft_gate(F.col(c), t)).otherwise(F.lit(1.0)) for c, t in (("stance", stance), ("confidence", confidence)) if t > 0]
        return edges.withColumn("weight", reduce(lambda a, b: a * b, gate, weight))
    fails = [F.coalesce(F.col(c) < t, F.lit(False)) for c, t in (("accuracy", accuracy), ("stance", stance), ("confidence", confidence)) if t > 0]
    out = reduce(lambda a, b: a | b, fails, F.lit(False))
    return edges.filter(~out).withColumn("weight", weight) if prune else edges.withColumn("weight", F.when(out, 0.0).otherwise(weight))


def node_similarity(parts: dict[str, Column], has_axiom: Column, has_anchor: Column, same_id: Column) -> Column:
    """The blend of a node pair's ``axiom, name, anchor, type, status`` similarities; an exact id lifts it to ``SAME_ID`` at least."""

    def blend(key: tuple[bool, bool]) -> Column:
        return reduce(lambda a, b: a + b, (F.lit(w) * parts[c] for c, w in NODE_BLENDS[key].items()))

    whole = F.when(has_axiom & has_anchor, blend((True, True))).when(has_axiom, blend((True, False))).when(has_anchor, blend((False, True))).otherwise(blend((False, False)))
    return F.when(same_id, F.greatest(whole, F.lit(SAME_ID))).otherwise(whole)


def type_similarity(a: Column, b: Column) -> Column:
    formal = ("actual_model", "axiom")
    return F.when(a == b, 1.0).when(a.isin(*formal) & b.isin(*formal), 0.95).otherwise(0.0)


def name_similarity(a: Column, b: Column, same_id: Column) -> Column:
    """Jaccard similarity of the names' words; where one has none, whether the ids agree."""
    words = lambda x: F.array_remove(F.array_distinct(F.split(F.lower(x), "\\s+")), "")
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(same_id.cast("double"))


def anchor_similarity(box: Column, table: Column, figure: Column, formula: Column, span: Column, quote: Column, doc_differs: Column, neither: Column, one: Column) -> Column:
    """The overlap of two anchors by the first modality that both have (each argument is null where they do not)."""
    return F.when(neither, 1.0).when(one | doc_differs, 0.0).otherwise(F.coalesce(box, table, figure, formula, span, quote, F.lit(0.0)))


def edge_fidelity(same_relation: Column, same_polarity: Column, weight: Column, predicted: Column) -> Column:
    """How well a predicted edge renders a reference edge: relation, polarity and weight."""
    size = F.greatest(F.lit(0.0), 1 - F.abs(weight - predicted) / F.greatest(weight, F.lit(1.0)))
    return 0.5 * F.when(same_relation, 1.0).otherwise(0.5) + 0.3 * same_polarity.cast("double") + 0.2 * size


def best_edge_fidelity(reference: DataFrame, predicted: DataFrame, matched: DataFrame) -> DataFrame:
    """Per reference edge the score of its best predicted counterpart, 0 where an end has no match or no edge joins the matches.

    Edges have ``source, target, relation, polarity, weight``; ``matched`` is ``node_id, match``.
    """
    ends = reference
    for end in ("source", "target"):
        ends = ends.join(matched.select(F.col("node_id").alias(end), F.col("match").alias(f"{end}_match")), end, "left")
    p = predicted.select(F.col("source").alias("source_match"), F.col("target").alias("target_match"), F.col("relation").alias("p_relation"), F.col("polarity").alias("p_polarity"), F.col("weight").alias("p_weight"))
    score = edge_fidelity(F.col("relation") == F.col("p_relation"), F.col("polarity") == F.col("p_polarity"), F.col("weight"), F.col("p_weight"))
    return ends.join(p, ["source_match", "target_match"], "left").groupBy("source", "target", "relation").agg(F.coalesce(F.max(score), F.lit(0.0)).alias("fidelity"))


def completeness(reference: DataFrame, matched: DataFrame) -> DataFrame:
    """From ``node_id, class`` and matched ``node_id``: one row of component completeness and axiomatic omission rate."""
    hit = reference.join(matched.select("node_id", F.lit(True).alias("hit")).distinct(), "node_id", "left")
    axioms = F.col("class") == "actual_model"
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    return hit.agg(share(F.count("hit"), F.count("*"), 1.0).alias("mcc"), share(F.count_if(axioms & F.col("hit").isNull()), F.count_if(axioms), 0.0).alias("aor"))


def edge_tenability(edges: DataFrame, params: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per edge: ``tenability`` = 1 less the largest difference of a parameter that both ends have, 1 where they share none, and whether that is an anomaly.

    ``edges`` has ``source, target``; ``params`` is ``node_id, name, value``.
    """
    pair = edges.select("source", "target").distinct()
    s = params.select(F.col("node_id").alias("source"), "name", F.col("value").alias("a"))
    t = params.select(F.col("node_id").alias("target"), "name", F.col("value").alias("b"))
    delta = pair.join(s, "source").join(t, ["target", "name"]).groupBy("source", "target").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("delta"))
    score = unit(1 - F.coalesce("delta", F.lit(0.0)))
    return pair.join(delta, ["source", "target"], "left").select("source", "target", F.round(score, 3).alias("tenability"), (score < threshold).alias("anomaly"))


def theory_tenability(local: DataFrame, edges: DataFrame, weight_local: float = 0.5, weight_edge: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """``local(node_id, score)`` and each node's edge tenabilities (1 where it has none) in one weighted score, and whether the node is tenable."""
    own = edges.groupBy(F.col("source").alias("node_id")).agg(F.avg("tenability").alias("edge"))
    whole = F.round(weight_local * F.col("score") + weight_edge * F.coalesce("edge", F.lit(1.0)), 3)
    return local.join(own, "node_id", "left").select("node_id", whole.alias("tenability"), (whole >= threshold).alias("tenable"))


def metric_winner(metric: Column, a: Column, b: Column) -> Column:
    """Which of two values of a metric is better: costs, times and error rates are better when lower."""
    lower = F.lower(metric).rlike("cost|token|latency|duration|time|omission_rate|hallucination_rate|error|aor")
    return F.when(a == b, "tie").when((a > b) != lower, "a").otherwise("b")


def claimants(clusters: DataFrame, theories: DataFrame) -> DataFrame:
    """``cluster_id, theory_id``: a theory claims a cluster if they share a dimension (whatever its case) or a node, or if the cluster's text names the theory.

    ``clusters(cluster_id, dimensions, text, node_ids)``, ``theories(theory_id, name, dimensions, node_ids)``.  Each of the three
    conditions is a join of its own on a key, or a phrase search; their rows are united.
    """
    def shared(column):
        value = lambda df, key: df.select(key, F.explode(column).alias("v")).select(key, F.lower("v").alias("v") if column == "dimensions" else "v").filter("v IS NOT NULL").distinct()
        return value(clusters, "cluster_id").join(value(theories, "theory_id"), "v").select("cluster_id", "theory_id")

    texts = clusters.select(F.col("cluster_id").alias("doc_id"), F.lower("text").alias("text"))
    named = find_phrases(texts, theories.select(F.col("theory_id").alias("phrase_id"), F.lower("name").alias("phrase"))).select(F.col("doc_id").alias("cluster_id"), F.col("phrase_id").alias("theory_id"))
    return shared("dimensions").unionByName(shared("node_ids")).unionByName(named).distinct()
