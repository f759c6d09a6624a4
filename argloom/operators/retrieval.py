"""Vector search on sparse hash embeddings, ranking metrics, consolidation of similar entities, conformal sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions.text import dense, set_jaccard, sparse_embedding
from argloom.operators.graph import components
from argloom.operators.iterate import cut, sent_if_few
from argloom.operators.vector_join import links, search_blocks, similar_pairs


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, doc_id, score, rank``: for each query (``query_id, text``) the ``k`` documents (``doc_id, text``) of highest dot product, negative ones as 0.

    Blocks of document vectors are scored against blocks of query vectors; a task keeps ``k`` documents per query.
    """
    return search_blocks(sparse_embedding(docs, "doc_id", "text"), sparse_embedding(queries, "query_id", "text"), k, 128)


def meets(docs: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(query_id, doc_id)`` whose vectors share a slot; only the vectors of these pairs are joined."""
    d = sparse_embedding(docs.join(sent_if_few(pairs.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("slots").alias("ds"))
    q = sparse_embedding(queries, "query_id", "text").select(F.col("id").alias("query_id"), F.col("slots").alias("qs"))
    return pairs.select("query_id", "doc_id").distinct().join(d, "doc_id").join(q, "query_id").filter(F.arrays_overlap("ds", "qs")).select("query_id", "doc_id")


def rank_metrics(ranking: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per query of ``gold(query_id, doc_id)``: reciprocal rank, hits at 1, 3 and ``k``, average precision and nDCG at ``k``; no hit gives 0."""
    total = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    hits = ranking.filter(F.col("rank") <= k).join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_p", F.count("*").over(running) / F.col("rank"))
    found = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum("_p").alias("precisions"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hit = lambda n: zero((F.col("first") <= n).cast("double"))
    return total.join(found, "query_id", "left").select(
        "query_id",
        zero(1 / F.col("first")).alias("mrr"),
        hit(1).alias("hits_1"),
        hit(3).alias("hits_3"),
        hit(k).alias("hits_k"),
        zero(F.col("precisions") / F.col("n_gold")).alias("ap"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def consolidate(vectors: DataFrame, relations: DataFrame, least: float, overlap: float, dim: int) -> DataFrame:
    """Canonical map ``id, canonical``: components of entities with one label, a cosine of ``least`` or more and a Jaccard index of their relations of ``overlap`` or more.

    ``vectors(id, label, v)``, ``relations(id, signature)``.  Entities alike in label, vector and relations are one to begin
    with, so a large group of copies costs one vector.  No relations on either side count as alike.  Without a label an
    entity stays its own.
    """
    sets = relations.groupBy("id").agg(F.sort_array(F.collect_set("signature")).alias("r"))
    given = vectors.join(sets, "id", "left").select("id", "label", "v", F.coalesce("r", F.array().cast("array<string>")).alias("r"))
    key = F.when(F.col("label").isNotNull(), F.sha2(F.to_json(F.struct("label", "v", "r")), 256))
    given = given.withColumn("key", key)
    heads = given.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"), F.first("r").alias("r"))
    heads = cut(heads)
    found = components(cut(links(heads, least, overlap, dim)).select(F.col("a").alias("source"), F.col("b").alias("target")))
    named = heads.join(found.withColumnRenamed("node_id", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("canonical"))
    return given.select("id", "key").join(named, "key", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def clusters(vectors: DataFrame, least: float, dim: int) -> DataFrame:
    """``id, cluster`` (its least id) of ``vectors(id, v)`` that are within a cosine of ``least`` of another, directly or over others; those alone are left out.

    Equal vectors are put together first; they are like each other unless they have no length.
    """
    given = vectors.withColumn("key", F.sha2(F.to_json(F.struct("v")), 256))
    heads = cut(given.groupBy("key").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("n")))
    pairs = similar_pairs(heads.select("id", F.lit(0).alias("label"), "v"), least, dim)
    found = components(pairs.select(F.col("a").alias("source"), F.col("b").alias("target"))).withColumnRenamed("node_id", "id")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    named = heads.join(found, "id", "left").filter(F.col("component").isNotNull() | ((F.col("n") > 1) & (length > 0))).select("key", F.coalesce("component", "id").alias("cluster"))
    return given.select("id", "key").join(named, "key").select("id", "cluster")


def soft_matches(pred: DataFrame, gold: DataFrame, least: float) -> DataFrame:
    """``pred, gold, similarity``: for each label of ``pred(label)`` the most similar one of ``gold(label)``, if it reaches ``least``; of equal ones the first.

    Distinct labels of both sides are one set of vectors; a label that stands on both sides is its own best match.
    """
    one, two = pred.select("label").distinct(), gold.select("label").distinct()
    sides = one.withColumn("in_pred", F.lit(1)).join(two.withColumn("in_gold", F.lit(1)), "label", "full").filter("label IS NOT NULL")
    vectors = dense(sparse_embedding(sides.select("label", F.col("label").alias("text")), "label", "text"))
    pairs = similar_pairs(vectors.withColumn("label", F.lit(0)), least, 128)
    own = vectors.select(F.col("id").alias("pred"), F.col("id").alias("gold"), F.lit(1.0).alias("similarity"))
    both = pairs.select(F.col("a").alias("pred"), F.col("b").alias("gold"), "similarity").unionByName(pairs.select(F.col("b").alias("pred"), F.col("a").alias("gold"), "similarity")).unionByName(own)
    kept = both.join(one.withColumnRenamed("label", "pred"), "pred", "left_semi").join(two.withColumnRenamed("label", "gold"), "gold", "left_semi")
    best = kept.groupBy("pred").agg(F.min_by(F.struct("gold", "similarity"), F.struct(-F.col("similarity"), "gold")).alias("m"))
    return best.select("pred", "m.gold", "m.similarity")


def linked(mentions: DataFrame, candidates: DataFrame, k: int, least: float) -> DataFrame:
    """``mention_id, candidate_id, score, outcome``: of the ``k`` candidates nearest to a mention, the best by share of common words, if it reaches ``least``.

    ``mentions(mention_id, text)``, ``candidates(candidate_id, text)``.  ``outcome`` is ``linked``, ``ambiguous`` if several candidates
    share the best score (no link then), or ``novel``; a mention near no candidate is novel.
    """
    near = cut(search(candidates.withColumnRenamed("candidate_id", "doc_id"), mentions.withColumnRenamed("mention_id", "query_id"), k))
    candidates = candidates.join(sent_if_few(near.select(F.col("doc_id").alias("candidate_id")).distinct()), "candidate_id", "left_semi")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))
    both = near.select(F.col("query_id").alias("mention_id"), F.col("doc_id").alias("candidate_id")).join(mentions.select("mention_id", words("text").alias("mw")), "mention_id").join(candidates.select("candidate_id", words("text").alias("cw")), "candidate_id")
    scored = both.select("mention_id", "candidate_id", set_jaccard(F.col("mw"), F.col("cw"), 1.0).alias("score"))
    best = scored.groupBy("mention_id").agg(F.max(F.struct("score", -F.col("candidate_id"))).alias("b"), F.collect_list("score").alias("s"))
    ties = F.size(F.filter("s", lambda x: x == F.col("b.score")))
    outcome = F.when(F.coalesce(F.col("b.score"), F.lit(0.0)) < least, "novel").when(ties > 1, "ambiguous").otherwise("linked")
    rows = mentions.select("mention_id").join(best, "mention_id", "left").withColumn("outcome", outcome)
    return rows.select("mention_id", F.when(F.col("outcome") == "linked", -F.col("b.col2")).alias("candidate_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"), "outcome")


def adaptive_sets(probabilities: DataFrame, alpha: float) -> DataFrame:
    """From ``key, option, p``: the most likely options until their mass reaches ``1 - alpha``."""
    before = Window.partitionBy("key").orderBy(F.desc("p"), "option").rowsBetween(Window.unboundedPreceding, -1)
    return probabilities.withColumn("_mass", F.coalesce(F.sum("p").over(before), F.lit(0.0))).filter(F.round("_mass", 9) < 1 - alpha).drop("_mass")


def conformal_quantile(scores: DataFrame, alpha: float, parts: int = 64) -> DataFrame:
    """One row ``n, quantile``: the score at rank ``ceil((n + 1)(1 - alpha))``, 1.0 beyond the last.

    Distinct scores are counted and dealt to ranges; the range that holds the rank is found from the ranges' counts, and
    only it is sorted.
    """
    counts = cut(scores.filter("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("c")).repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()))
    upto = counts.groupBy("part").agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("part")))  # a row per range
    n = scores.agg(F.count("*").alias("n")).withColumn("wanted", F.ceil((F.col("n") + 1) * (1 - alpha)))
    part = n.join(F.broadcast(upto), F.lit(True), "left").groupBy("n", "wanted").agg(F.min(F.when(F.col("upto") >= F.col("wanted"), F.struct("part", F.col("upto") - F.col("c")))).alias("p"))
    part = part.select("n", "wanted", F.col("p.part").alias("part"), F.col("p.col2").alias("before"))
    inner = counts.join(F.broadcast(part), "part").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("score")))
    found = inner.agg(F.min(F.when(F.col("upto") >= F.col("wanted"), F.col("score"))).alias("q"))
    return n.join(F.broadcast(found), F.lit(True)).select("n", F.coalesce("q", F.lit(1.0)).alias("quantile"))
