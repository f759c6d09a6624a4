"""Queries of filters, joins, aggregates, sets, writes and top-k over the bound graph and key tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from argloom.operators import relational as R
from argloom.operators.cooccurrence import shared_groups
from argloom.operators.iterate import TASK_ROWS
from argloom.operators.vector_join import similar_pairs
from argloom.plans.bindings import EDGES_SQL, NODES_SQL, PREDICTIONS_SQL, SNAPSHOTS_SQL, edges, lines_and_orders, nodes, predictions, query, snapshots, table

N_E = f"WITH {NODES_SQL}, {EDGES_SQL} "


@query("flt01_property_filter", f"WITH {NODES_SQL} SELECT node_id, name FROM n WHERE node_type = 'claim' AND nation = 7")
def _(spark, d):
    return R.with_properties(nodes(spark, d), node_type="claim", nation=7).select("node_id", "name")


@query("flt02_label_in", f"WITH {NODES_SQL} SELECT node_id, node_type FROM n WHERE node_type IN ('axiom', 'hypothesis') AND layer = 'L3'")
def _(spark, d):
    return nodes(spark, d).filter(F.col("node_type").isin("axiom", "hypothesis") & (F.col("layer") == "L3")).select("node_id", "node_type")


@query("flt03_name_search", f"WITH {NODES_SQL} SELECT node_id, name FROM n WHERE contains(lower(name), 'customer#00000001') OR contains('customer#00000001', lower(name))")
def _(spark, d):
    return R.name_search(nodes(spark, d), "Customer#00000001").select("node_id", "name")


@query("flt04_name_equal", f"WITH {NODES_SQL} SELECT node_id, name FROM n WHERE lower(name) IN ('supplier#000000003', 'customer#000000011')")
def _(spark, d):
    return nodes(spark, d).filter(F.lower("name").isin("supplier#000000003", "customer#000000011")).select("node_id", "name")


@query("flt05_unprocessed_flag", "SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.quality = 1, false)")
def _(spark, d):
    flagged = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return flagged.filter(~F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id")


@query("flt06_unprocessed_keys", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, d):
    return R.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query(
    "flt07_pending_chunks",
    "SELECT lang, count(*) AS n_pending, min(doc_id) AS first_pending FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
)
def _(spark, d):
    left = R.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return left.groupBy("lang").agg(F.count("*").alias("n_pending"), F.min("doc_id").alias("first_pending"))


@query("flt08_confidence_threshold", f"WITH {EDGES_SQL} SELECT relation, count(*) AS n_kept, count(*) FILTER (confidence IS NULL) AS n_null FROM e WHERE confidence IS NULL OR confidence >= 0.7 GROUP BY relation")
def _(spark, d):
    return edges(spark, d).filter(R.at_least("confidence", 0.7)).groupBy("relation").agg(F.count("*").alias("n_kept"), F.count_if(F.col("confidence").isNull()).alias("n_null"))


@query("flt09_ontology_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type")
def _(spark, d):
    allowed = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string")
    return table(spark, d, "events").join(F.broadcast(allowed), "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt10_endpoint_validation", N_E + "SELECT relation, count(*) AS n FROM e WHERE source IN (SELECT node_id FROM n WHERE prior > 0.3) AND target IN (SELECT node_id FROM n WHERE prior > 0.3) GROUP BY relation")
def _(spark, d):
    return R.within(edges(spark, d), nodes(spark, d).filter("prior > 0.3")).groupBy("relation").agg(F.count("*").alias("n"))


@query("flt11_edges_of_node", f"WITH {EDGES_SQL} SELECT l_orderkey, l_linenumber, source, target, relation FROM e WHERE source = 's1' OR target = 'c1'")
def _(spark, d):
    return edges(spark, d).filter((F.col("source") == "s1") | (F.col("target") == "c1")).select("l_orderkey", "l_linenumber", "source", "target", "relation")


@query("flt14_item_classes", f"WITH {SNAPSHOTS_SQL} SELECT epoch, kind, count(*) AS n_items FROM snap GROUP BY epoch, kind")
def _(spark, d):
    return snapshots(spark, d).groupBy("epoch", "kind").agg(F.count("*").alias("n_items"))


@query(
    "flt16_hard_gate",
    f"WITH {EDGES_SQL} SELECT relation, count(*) AS n, count(*) FILTER (coalesce(weight < 0.4, false) OR coalesce(confidence < 0.3, false)) AS n_pruned,"
    " round(sum(CASE WHEN coalesce(weight < 0.4, false) OR coalesce(confidence < 0.3, false) THEN 0 ELSE weight END), 4) AS gated_weight FROM e GROUP BY relation",
)
def _(spark, d):
    gated = R.gate(edges(spark, d), 0.4, 0.3)
    return gated.groupBy("relation").agg(F.count("*").alias("n"), F.count_if("pruned").alias("n_pruned"), F.round(F.sum("gated_weight"), 4).alias("gated_weight"))


@query("flt19_type_violations", f"WITH {NODES_SQL} SELECT node_type, count(*) AS n FROM n WHERE node_type NOT IN ('claim', 'evidence', 'axiom') GROUP BY node_type")
def _(spark, d):
    return nodes(spark, d).filter(~F.col("node_type").isin("claim", "evidence", "axiom")).groupBy("node_type").agg(F.count("*").alias("n"))


@query("flt20_layer_filter", N_E + "SELECT source, target, count(*) AS n FROM e WHERE source IN (SELECT node_id FROM n WHERE nation < 5) AND target IN (SELECT node_id FROM n WHERE nation < 5) GROUP BY source, target")
def _(spark, d):
    return R.within(edges(spark, d), nodes(spark, d).filter("nation < 5")).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("flt23_similarity_band", f"WITH {PREDICTIONS_SQL} SELECT doc_id, label, CASE WHEN label = 1 THEN 'confirmed' ELSE 'open' END AS status FROM pred WHERE confidence BETWEEN 0.25 AND 0.5")
def _(spark, d):
    return predictions(spark, d).filter(F.col("confidence").between(0.25, 0.5)).select("doc_id", "label", F.when(F.col("label") == 1, "confirmed").otherwise("open").alias("status"))


@query("flt26_ignored_keys", "SELECT event_type, count(*) AS n FROM events WHERE NOT regexp_matches(event_type, 'error|sign') GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").filter(~F.col("event_type").rlike("error|sign")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt27_component_threshold", N_E + "SELECT count(*) AS n_edges, count(DISTINCT source) AS n_sources FROM e WHERE source IN (SELECT node_id FROM n WHERE prior >= 0.5) AND target IN (SELECT node_id FROM n WHERE prior >= 0.5)")
def _(spark, d):
    kept = R.within(edges(spark, d), nodes(spark, d).filter(R.at_least("prior", 0.5)))
    return kept.agg(F.count("*").alias("n_edges"), F.count_distinct("source").alias("n_sources"))


@query("prj02_label_truncation", "SELECT item_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS label, left(text, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS label_long FROM benchmark")
def _(spark, d):
    text, long = F.col("text"), F.length("text") > 60
    return table(spark, d, "benchmark").select(
        "item_id",
        F.when(long, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text).alias("label"),
        F.concat(F.substring(text, 1, 60), F.when(long, "...").otherwise("")).alias("label_long"),
    )


@query("prj03_layer_from_label", f"WITH {NODES_SQL} SELECT CASE WHEN node_type = 'evidence' THEN 'empirical' WHEN node_type = 'axiom' THEN 'core' ELSE 'theoretical' END AS layer_kind, count(*) AS n FROM n GROUP BY 1")
def _(spark, d):
    kind = F.when(F.col("node_type") == "evidence", "empirical").when(F.col("node_type") == "axiom", "core").otherwise("theoretical")
    return nodes(spark, d).groupBy(kind.alias("layer_kind")).agg(F.count("*").alias("n"))


@query("prj06_decision_tier", f"WITH {PREDICTIONS_SQL} SELECT CASE WHEN confidence >= 0.85 THEN 'system_1' WHEN label = 1 THEN 'system_2' ELSE 'legacy' END AS tier, count(*) AS n FROM pred GROUP BY 1")
def _(spark, d):
    tier = F.when(F.col("confidence") >= 0.85, "system_1").when(F.col("label") == 1, "system_2").otherwise("legacy")
    return predictions(spark, d).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("prj07_artifact_ids", "SELECT doc_id, 'chunk::' || doc_id || '::' || substr(sha256(text), 1, 16) AS artifact_id, sha256(lang || '|' || source) AS fingerprint FROM documents")
def _(spark, d):
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("chunk::"), "doc_id", F.lit("::"), F.substring(sha(F.col("text")), 1, 16)).alias("artifact_id"),
        sha(F.concat_ws("|", "lang", "source")).alias("fingerprint"),
    )


@query("joi01_named_endpoints", N_E + "SELECT coalesce(a.name, source) AS source_name, coalesce(b.name, target) AS target_name, count(*) AS n FROM e LEFT JOIN n a ON a.node_id = source LEFT JOIN (SELECT * FROM n WHERE prior > 0.5) b ON b.node_id = target GROUP BY 1, 2")
def _(spark, d):
    every = nodes(spark, d)
    some = every.filter("layer = 'L2' OR prior > 0.5")
    return R.named_ends(edges(spark, d), some).groupBy("source_name", "target_name").agg(F.count("*").alias("n"))


@query("joi03_named_digraph", N_E + "SELECT DISTINCT a.name AS source, b.name AS target FROM e JOIN n a ON a.node_id = source JOIN n b ON b.node_id = target WHERE relation = 'attacks'")
def _(spark, d):
    names = nodes(spark, d).select("node_id", "name")
    found = edges(spark, d).filter("relation = 'attacks'").select("source", "target").distinct()
    found = found.join(names.select(F.col("node_id").alias("source"), F.col("name").alias("a")), "source").join(names.select(F.col("node_id").alias("target"), F.col("name").alias("b")), "target")
    return found.select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


@query("joi04_mention_chunks", "SELECT source AS entity, doc_id // 500 AS part, count(DISTINCT doc_id) AS n_chunks, min(doc_id) AS first_chunk, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS chunks FROM documents GROUP BY 1, 2")
def _(spark, d):
    # An entity's chunks come in parts of a bounded range of ids, so that one with a third of all chunks is no single row.
    mentions = table(spark, d, "documents").groupBy("source", F.expr("doc_id div 500").alias("part")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    return mentions.select(F.col("source").alias("entity"), "part", F.size("ids").cast("bigint").alias("n_chunks"), F.col("ids")[0].alias("first_chunk"), F.concat_ws(",", F.col("ids").cast("array<string>")).alias("chunks"))


@query("joi05_polarity_lookup", f"WITH {EDGES_SQL}, p(relation, sign) AS (VALUES ('attacks', -1), ('supports', 1)) SELECT e.relation, coalesce(p.sign, 0) AS sign, count(*) AS n FROM e LEFT JOIN p ON e.relation = p.relation GROUP BY 1, 2")
def _(spark, d):
    signs = spark.createDataFrame([("attacks", -1), ("supports", 1)], "relation string, sign int")
    return edges(spark, d).join(F.broadcast(signs), "relation", "left").groupBy("relation", F.coalesce("sign", F.lit(0)).alias("sign")).agg(F.count("*").alias("n"))


@query("joi07_dangling_endpoints", N_E + "SELECT node_id, count(*) AS n_edges FROM (SELECT source AS node_id FROM e UNION ALL SELECT target FROM e) x WHERE node_id NOT IN (SELECT node_id FROM n WHERE prior < 0.9) GROUP BY node_id")
def _(spark, d):
    return R.dangling_ends(edges(spark, d), nodes(spark, d).filter("prior < 0.9"))


@query(
    "joi08_reified_edges",
    f"WITH {EDGES_SQL}, k AS (SELECT l_orderkey AS o, l_linenumber AS n, source FROM e), x AS (SELECT a.source AS source, 'inference::' || b.o || '-' || b.n AS target FROM k a JOIN k b ON b.o = a.o AND b.n = a.n + 1)"
    " SELECT source, count(*) AS n, min(target) AS first_target FROM x GROUP BY source",
)
def _(spark, d):
    """Each line of an order is an edge that targets the edge of the line before; a targeted edge stands as an inference."""
    k = edges(spark, d).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "source")
    b = k.select("o", (F.col("n") - 1).alias("n"), F.concat(F.lit("inference::"), F.col("o"), F.lit("-"), F.col("n")).alias("target"))
    x = k.join(b, ["o", "n"]).select("source", "target")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("first_target"))


@query("joi09_shared_chunk_pairs", "WITH m AS (SELECT DISTINCT o_custkey AS a, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT x.a AS a, y.a AS b, count(*) AS n_shared FROM m x JOIN m y ON x.p = y.p AND x.a < y.a GROUP BY 1, 2")
def _(spark, d):
    # Pairs of customers that share a part: the blocking key is the part.
    line, orders = lines_and_orders(spark, d)
    return shared_groups(line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("p")), TASK_ROWS)


@query(
    "joi11_same_label_similarity",
    "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, a.label AS label, round(list_dot_product(a.v, b.v), 5) AS similarity"
    " FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.3",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return similar_pairs(v, 0.3, 64).withColumn("similarity", F.round("similarity", 5))


@query("joi14_canonical_redirect", f"WITH {EDGES_SQL}, c AS (SELECT 's' || s_suppkey AS id, 's' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS canonical FROM supplier) SELECT coalesce(canonical, source) AS source, relation, count(*) AS n FROM e LEFT JOIN c ON c.id = e.source GROUP BY 1, 2")
def _(spark, d):
    canonical = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("s"), F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))).alias("canonical"))
    return edges(spark, d).join(canonical, "source", "left").groupBy(F.coalesce("canonical", "source").alias("source"), "relation").agg(F.count("*").alias("n"))


@query("joi16_direct_disjointness", f"WITH {EDGES_SQL} SELECT source, target, count(*) FILTER (polarity = 1) AS n_support, count(*) FILTER (polarity = -1) AS n_attack FROM e GROUP BY 1, 2 HAVING count(*) FILTER (polarity = 1) > 0 AND count(*) FILTER (polarity = -1) > 0")
def _(spark, d):
    both = edges(spark, d).groupBy("source", "target").agg(F.count_if(F.col("polarity") == 1).alias("n_support"), F.count_if(F.col("polarity") == -1).alias("n_attack"))
    return both.filter("n_support > 0 AND n_attack > 0")


@query(
    "joi18_premise_claim_objection",
    f"WITH {EDGES_SQL} SELECT s.target AS claim, count(DISTINCT s.source) AS n_premises, count(DISTINCT a.source) AS n_objections FROM e s JOIN e a ON s.target = a.target AND s.relation = 'supports' AND a.relation = 'attacks' GROUP BY 1",
)
def _(spark, d):
    # Both sides are counted per claim before they meet, so no pairs of premises and objections are built.
    e = edges(spark, d)
    side = lambda kind, name: e.filter(F.col("relation") == kind).groupBy(F.col("target").alias("claim")).agg(F.count_distinct("source").alias(name))
    return side("supports", "n_premises").join(side("attacks", "n_objections"), "claim")


_RUN = "SELECT 'c' || o_custkey AS source, 'p' || substr(o_orderpriority, 1, 1) AS target, avg(o_totalprice) / 100000 AS weight, max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END) AS polarity FROM orders WHERE year(o_orderdate) = {year} GROUP BY 1, 2"
_RUNS = f"a AS ({_RUN.format(year=1995)}), b AS ({_RUN.format(year=1996)})"
_DIFF = (
    _RUNS + ", x AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN a.weight IS NULL THEN 'gained' WHEN b.weight IS NULL THEN 'lost'"
    " WHEN a.polarity * b.polarity < 0 THEN 'inverted' WHEN abs(b.weight - a.weight) >= 0.15 THEN 'weight_shifted' ELSE 'retained' END AS status FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target)"
)


def runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    orders = table(spark, d, "orders")
    return [
        orders.filter(F.year("o_orderdate") == year)
        .groupBy(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("target"))
        .agg((F.avg("o_totalprice") / 100000).alias("weight"), F.max(status).alias("polarity"))
        for year in (1995, 1996)
    ]


@query("joi19_run_diff_nodes", f"WITH {_RUNS}, x AS (SELECT DISTINCT source FROM a), y AS (SELECT DISTINCT source FROM b) SELECT coalesce(x.source, y.source) AS node_id, CASE WHEN x.source IS NULL THEN 'gained' WHEN y.source IS NULL THEN 'lost' ELSE 'retained' END AS status FROM x FULL JOIN y ON x.source = y.source")
def _(spark, d):
    a, b = (r.select(F.col("source").alias("node_id")).distinct() for r in runs(spark, d))
    return R.node_diff(a, b)


@query("joi20_run_diff_edges", f"WITH {_DIFF} SELECT source, target, status FROM x")
def _(spark, d):
    return R.edge_diff(*runs(spark, d)).select("source", "target", "status")


@query(
    "joi22_metric_comparison",
    "WITH a AS (SELECT event_type || '_cost' AS metric, sum(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type || '_cost' AS metric, sum(value) AS v FROM events WHERE user_id % 2 = 1 AND event_type <> 'error' GROUP BY 1)"
    " SELECT coalesce(a.metric, b.metric) AS metric, round(coalesce(b.v, 0) - coalesce(a.v, 0), 3) AS delta, CASE WHEN coalesce(b.v, 0) = coalesce(a.v, 0) THEN 'tie' WHEN coalesce(b.v, 0) > coalesce(a.v, 0) THEN 'a' ELSE 'b' END AS winner FROM a FULL JOIN b ON a.metric = b.metric",
)
def _(spark, d):
    events = table(spark, d, "events")
    of = lambda rows: rows.groupBy(F.concat("event_type", F.lit("_cost")).alias("metric")).agg(F.sum("value").alias("value"))
    return R.compare_metrics(of(events.filter("user_id % 2 = 0")), of(events.filter("user_id % 2 = 1 AND event_type <> 'error'"))).select("metric", F.round("delta", 3).alias("delta"), "winner")


@query("joi25_reused_records", "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY 1")
def _(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "joi30_polarity_concordance",
    f"WITH {EDGES_SQL}, x AS (SELECT source, target, max(polarity) AS p FROM e WHERE epoch <= 1995 GROUP BY 1, 2), y AS (SELECT source, target, max(polarity) AS p FROM e WHERE epoch > 1995 GROUP BY 1, 2)"
    " SELECT count(*) AS n_shared, count(*) FILTER (x.p = y.p) AS n_same, round(avg(CASE WHEN x.p = y.p THEN 1.0 ELSE 0.0 END), 6) AS concordance FROM x JOIN y ON x.source = y.source AND x.target = y.target",
)
def _(spark, d):
    e = edges(spark, d)
    side = lambda cond, name: e.filter(cond).groupBy("source", "target").agg(F.max("polarity").alias(name))
    both = side("epoch <= 1995", "p").join(side("epoch > 1995", "q"), ["source", "target"])
    return both.agg(F.count("*").alias("n_shared"), F.count_if(F.col("p") == F.col("q")).alias("n_same"), F.round(F.avg((F.col("p") == F.col("q")).cast("double")), 6).alias("concordance"))


@query("agg01_graph_summary", N_E + "SELECT n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 8) AS density FROM (SELECT count(*) AS n_nodes FROM n), (SELECT count(*) AS n_edges FROM e)")
def _(spark, d):
    return R.graph_summary(nodes(spark, d), edges(spark, d)).withColumn("density", F.round("density", 8))


@query("agg02_counts_by_type", N_E + "SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY 2")
def _(spark, d):
    a = nodes(spark, d).groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    b = edges(spark, d).groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("relation"))
    return a.unionByName(b)


@query("agg03_score_range", f"WITH {NODES_SQL} SELECT node_type, coalesce(min(prior), 0.0) AS min_score, coalesce(max(prior), 0.0) AS max_score, round(coalesce(avg(prior), 0.0), 6) AS mean_score FROM n GROUP BY node_type")
def _(spark, d):
    return nodes(spark, d).groupBy("node_type").agg(F.coalesce(F.min("prior"), F.lit(0.0)).alias("min_score"), F.coalesce(F.max("prior"), F.lit(0.0)).alias("max_score"), F.round(F.coalesce(F.avg("prior"), F.lit(0.0)), 6).alias("mean_score"))


@query("agg04_degree", N_E + "SELECT node_id, coalesce(k, 0) AS degree FROM n LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id) ON id = node_id")
def _(spark, d):
    return R.degrees(nodes(spark, d), edges(spark, d))


@query("agg05_degree_threshold", N_E + "SELECT id AS node_id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id HAVING count(*) > 80")
def _(spark, d):
    return R.degrees(nodes(spark, d), edges(spark, d)).filter("degree > 80")


@query("agg06_layer_counts", f"WITH {NODES_SQL} SELECT count(*) FILTER (layer = 'L2') AS n_l2, count(*) FILTER (layer = 'L3') AS n_l3, count(*) AS n FROM n")
def _(spark, d):
    return nodes(spark, d).agg(F.count_if(F.col("layer") == "L2").alias("n_l2"), F.count_if(F.col("layer") == "L3").alias("n_l3"), F.count("*").alias("n"))


@query("agg07_artifact_counts", "SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'F') AS n_reused, count(*) FILTER (o_orderstatus <> 'F') AS n_new FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_reused"), F.count_if(F.col("o_orderstatus") != "F").alias("n_new"))


@query("agg08_run_sizes", "SELECT user_id AS run_id, count(*) AS n_artifacts, sum(length(props))::BIGINT AS bytes, epoch(max(ts)) - epoch(min(ts)) AS duration_s FROM events GROUP BY 1")
def _(spark, d):
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n_artifacts"), F.sum(F.length("props")).cast("bigint").alias("bytes"), (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("duration_s"))


@query("agg10_parallel_edges", f"WITH {EDGES_SQL} SELECT least(source, target) AS a, greatest(source, target) AS b, round(sum(coalesce(confidence, 1.0)), 4) AS weight FROM e GROUP BY 1, 2")
def _(spark, d):
    return R.parallel_sum(edges(spark, d)).withColumn("weight", F.round("weight", 4))


@query("agg11_confidence_histogram", f"WITH {EDGES_SQL} SELECT floor(confidence * 10) / 10 AS bucket, count(*) AS n FROM e WHERE confidence IS NOT NULL GROUP BY 1")
def _(spark, d):
    return edges(spark, d).filter("confidence IS NOT NULL").groupBy((F.floor(F.col("confidence") * 10) / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("agg12_label_distribution", f"WITH {NODES_SQL} SELECT label, count(*) AS n FROM (SELECT unnest([node_type, layer]) AS label FROM n) GROUP BY label")
def _(spark, d):
    return nodes(spark, d).select(F.explode(F.array("node_type", "layer")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "agg13_energies",
    N_E + "SELECT target, round(coalesce(sum(CASE WHEN polarity = 1 THEN prior * weight END), 0), 4) AS support, round(coalesce(sum(CASE WHEN polarity = -1 THEN prior * weight END), 0), 4) AS attack FROM e JOIN n ON node_id = source GROUP BY target",
)
def _(spark, d):
    found = R.energies(edges(spark, d), nodes(spark, d).select("node_id", F.col("prior").alias("strength")))
    return found.select("target", F.round("support", 4).alias("support"), F.round("attack", 4).alias("attack"))


@query(
    "agg14_volatility",
    N_E + ", x AS (SELECT target, sum(prior * weight) AS en FROM e JOIN n ON node_id = source GROUP BY target)"
    " SELECT target, round(en, 4) AS evidence, round(CASE WHEN en > 0 THEN en / (1 + en) * (1 - 2 * abs(n.prior - 0.5)) ELSE 0 END, 5) AS volatility FROM x JOIN n ON node_id = target",
)
def _(spark, d):
    own = nodes(spark, d)
    total = R.energies(edges(spark, d), own.select("node_id", F.col("prior").alias("strength"))).select(F.col("target"), (F.col("support") + F.col("attack")).alias("en"))
    joined = total.join(own.select(F.col("node_id").alias("target"), "prior"), "target")
    return joined.select("target", F.round("en", 4).alias("evidence"), F.round(F.when(F.col("en") > 0, F.col("en") / (1 + F.col("en")) * (1 - 2 * F.abs(F.col("prior") - 0.5))).otherwise(0.0), 5).alias("volatility"))


@query("agg18_acceptance", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS acceptance FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("acceptance"))


@query(
    "agg19_diff_jaccard",
    f"WITH {_DIFF} SELECT count(*) FILTER (status IN ('retained', 'weight_shifted', 'inverted')) AS n_retained, count(*) FILTER (status = 'gained') AS n_gained, count(*) FILTER (status = 'lost') AS n_lost,"
    " round(count(*) FILTER (status IN ('retained', 'weight_shifted', 'inverted')) / count(*), 6) AS jaccard FROM x",
)
def _(spark, d):
    kept = F.col("status").isin("retained", "weight_shifted", "inverted")
    found = R.edge_diff(*runs(spark, d)).agg(F.count_if(kept).alias("n_retained"), F.count_if(F.col("status") == "gained").alias("n_gained"), F.count_if(F.col("status") == "lost").alias("n_lost"), F.count("*").alias("_all"))
    return found.withColumn("jaccard", F.round(F.when(F.col("_all") > 0, F.col("n_retained") / F.col("_all")).otherwise(1.0), 6)).drop("_all")


@query("agg24_clusters", "SELECT source AS cluster, count(*) AS n_atoms, count(DISTINCT lang) AS n_kinds, min(doc_id) AS first_atom FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("cluster")).agg(F.count("*").alias("n_atoms"), F.count_distinct("lang").alias("n_kinds"), F.min("doc_id").alias("first_atom"))


@query("agg29_duplicate_ids", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


@query("agg30_unmapped_predicates", f"WITH {EDGES_SQL} SELECT relation, count(*) AS n FROM e WHERE relation NOT IN ('attacks', 'supports') GROUP BY relation")
def _(spark, d):
    known = spark.createDataFrame([("attacks",), ("supports",)], "relation string")
    return edges(spark, d).join(F.broadcast(known), "relation", "left_anti").groupBy("relation").agg(F.count("*").alias("n"))


@query("agg31_memory_metrics", "SELECT conv_id, sum(greatest(1, floor(len(string_split(text, ' ')) * 1.35)))::BIGINT AS tokens, count(DISTINCT role) AS n_entities FROM conversations GROUP BY conv_id")
def _(spark, d):
    words = F.size(F.split("text", " "))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.greatest(F.lit(1), F.floor(words * 1.35))).cast("bigint").alias("tokens"), F.count_distinct("role").alias("n_entities"))


@query("agg34_boxplot", f"WITH {EDGES_SQL}, r AS (SELECT relation, weight, row_number() OVER (PARTITION BY relation ORDER BY weight) - 1 AS i, count(*) OVER (PARTITION BY relation) AS n FROM e) SELECT relation, max(weight) FILTER (i = 0) AS low, max(weight) FILTER (i = floor(n * 0.25)) AS q1, max(weight) FILTER (i = floor(n * 0.5)) AS median, max(weight) FILTER (i = floor(n * 0.75)) AS q3, max(weight) FILTER (i = n - 1) AS high FROM r GROUP BY relation")
def _(spark, d):
    # Nearest ranks from counts per distinct weight, so that no task sorts a whole relation.
    w = edges(spark, d).groupBy("relation", "weight").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("relation").orderBy("weight"))
    w = w.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("relation")))
    at = lambda q: F.min(F.when(F.col("upto") > q, F.col("weight")))
    n = F.col("n")
    return w.groupBy("relation").agg(F.min("weight").alias("low"), at(F.floor(n * 0.25)).alias("q1"), at(F.floor(n * 0.5)).alias("median"), at(F.floor(n * 0.75)).alias("q3"), F.max("weight").alias("high"))


@query(
    "agg35_kernel_density",
    f"WITH {PREDICTIONS_SQL}, c AS (SELECT confidence, count(*) AS k FROM pred GROUP BY 1), g AS (SELECT i / 100 AS x FROM range(0, 101) r(i))"
    " SELECT x, round(sum(k * exp(-0.5 * ((x - confidence) / 0.05) * ((x - confidence) / 0.05))) / (sum(k) * 0.05 * sqrt(2 * pi())), 5) AS density FROM g, c GROUP BY x",
)
def _(spark, d):
    samples = predictions(spark, d).groupBy("confidence").agg(F.count("*").alias("k"))
    grid = samples.select("confidence", "k", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i")).withColumn("x", F.col("i") / 100)
    z = (F.col("x") - F.col("confidence")) / 0.05
    return grid.groupBy("x").agg(F.round(F.sum(F.col("k") * F.exp(-0.5 * z * z)) / (F.sum("k") * 0.05 * F.sqrt(2 * F.pi())), 5).alias("density"))


@query("agg36_degree_frequency", N_E + "SELECT k AS degree, count(*) AS n_nodes FROM (SELECT node_id, count(id) AS k FROM n LEFT JOIN (SELECT source AS id FROM e UNION ALL SELECT target FROM e) ON id = node_id GROUP BY node_id) GROUP BY k")
def _(spark, d):
    return R.degrees(nodes(spark, d), edges(spark, d)).groupBy("degree").agg(F.count("*").alias("n_nodes"))


@query("set01_prf", "WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 1000), g AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT m AS matched, gg - m AS omitted, pp - m AS spurious, round(m / pp, 6) AS \"precision\", round(m / gg, 6) AS recall, round(2 * m / (pp + gg), 6) AS f1 FROM (SELECT count(*) AS pp FROM p), (SELECT count(*) AS gg FROM g), (SELECT count(*) AS m FROM p JOIN g USING (doc_id))")
def _(spark, d):
    found = R.prf(table(spark, d, "documents").filter("n_chars > 1000"), table(spark, d, "labels").filter("quality = 1"), ["doc_id"])
    return found.select("matched", "omitted", "spurious", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("set02_matched_omitted_spurious", "WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 1000), g AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'omitted' WHEN g.doc_id IS NULL THEN 'spurious' ELSE 'matched' END AS status FROM p FULL JOIN g ON p.doc_id = g.doc_id")
def _(spark, d):
    p, g = table(spark, d, "documents").filter("n_chars > 1000").select("doc_id"), table(spark, d, "labels").filter("quality = 1").select("doc_id")
    parts = [p.intersect(g).withColumn("status", F.lit("matched")), g.subtract(p).withColumn("status", F.lit("omitted")), p.subtract(g).withColumn("status", F.lit("spurious"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("set03_prf_by_group", "WITH p AS (SELECT doc_id, lang FROM documents WHERE n_chars > 1000), g AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1), x AS (SELECT coalesce(p.lang, g.lang) AS lang, p.doc_id AS a, g.doc_id AS b FROM p FULL JOIN g ON p.doc_id = g.doc_id) SELECT lang, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(a), 6) AS \"precision\", round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(b), 6) AS recall FROM x GROUP BY lang")
def _(spark, d):
    docs = table(spark, d, "documents")
    found = R.prf(docs.filter("n_chars > 1000"), docs.join(table(spark, d, "labels").filter("quality = 1"), "doc_id"), ["doc_id"], ["lang"])
    return found.select("lang", "matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("set04_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'local' AS kind FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'global' FROM orders) GROUP BY kind")
def _(spark, d):
    a = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.lit("local").alias("kind"))
    return a.unionByName(table(spark, d, "orders").select(F.lit("global").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("set05_new_since_last", f"WITH {SNAPSHOTS_SQL} SELECT b.epoch AS epoch, b.kind AS kind, count(*) AS n_new FROM snap b WHERE NOT EXISTS (SELECT 1 FROM snap a WHERE a.epoch = b.epoch - 1 AND a.kind = b.kind AND a.item = b.item) GROUP BY 1, 2")
def _(spark, d):
    s = snapshots(spark, d)
    before = s.withColumn("epoch", F.col("epoch") + 1)
    return s.join(before, ["epoch", "kind", "item"], "left_anti").groupBy("epoch", "kind").agg(F.count("*").alias("n_new"))


@query("set06_set_jaccard", "WITH m AS (SELECT DISTINCT s_nationkey AS a, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT a, count(*) AS n FROM m GROUP BY a) SELECT x.a AS a, y.a AS b, round(count(*) / (any_value(k1.n) + any_value(k2.n) - count(*)), 6) AS jaccard FROM m x JOIN m y ON x.p = y.p AND x.a < y.a JOIN k k1 ON k1.a = x.a JOIN k k2 ON k2.a = y.a GROUP BY 1, 2")
def _(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("a"), F.col("l_partkey").alias("p")).distinct()
    k = m.groupBy("a").agg(F.count("*").alias("n"))
    shared = m.join(m.select(F.col("a").alias("b"), "p"), "p").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("o"))
    both = shared.join(k, "a").join(k.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    return both.select("a", "b", F.round(F.col("o") / (F.col("n") + F.col("m") - F.col("o")), 6).alias("jaccard"))


@query("set07_relation_signatures", f"WITH {EDGES_SQL} SELECT node_id, count(DISTINCT sig) AS n_signatures, min(sig) AS first_signature FROM (SELECT source AS node_id, 'OUT:' || relation || ':' || target AS sig FROM e UNION ALL SELECT target, 'IN:' || relation || ':' || source FROM e) GROUP BY node_id")
def _(spark, d):
    e = edges(spark, d)
    out = e.select(F.col("source").alias("node_id"), F.concat_ws(":", F.lit("OUT"), "relation", "target").alias("sig"))
    into = e.select(F.col("target").alias("node_id"), F.concat_ws(":", F.lit("IN"), "relation", "source").alias("sig"))
    return out.unionByName(into).groupBy("node_id").agg(F.count_distinct("sig").alias("n_signatures"), F.min("sig").alias("first_signature"))


@query("mut01_upsert_nodes", "SELECT coalesce(o.c_custkey, n.s_suppkey) AS key, CASE WHEN n.s_suppkey IS NULL THEN o.c_name ELSE coalesce(o.c_name, n.s_name) END AS created, CASE WHEN n.s_suppkey IS NULL THEN o.c_acctbal ELSE n.s_acctbal END AS balance FROM customer o FULL JOIN supplier n ON o.c_custkey = n.s_suppkey")
def _(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("created"), F.col("c_acctbal").alias("balance"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("created"), F.col("s_acctbal").alias("balance"))
    return R.upsert(old, new, "key", ["created"])


@query("mut03_last_writer_wins", "SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, max(event_id) AS last_id FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("last_id"))


@query("mut04_membership_edges", "SELECT DISTINCT 'community::' || lang AS community, source AS member FROM documents")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.collect_set("source").alias("members")).select(F.concat(F.lit("community::"), "lang").alias("community"), F.explode("members").alias("member"))


@query("mut05_prune_children", "SELECT lang, count(*) AS n_pruned FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n_pruned"))


@query("mut06_label_backfill", "SELECT coalesce(CASE WHEN toxic = 1 THEN 'flagged' END, 'stamped') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return both.groupBy(F.coalesce(F.when(F.col("toxic") == 1, "flagged"), F.lit("stamped")).alias("label")).agg(F.count("*").alias("n"))


@query("top01_top_k", N_E + "SELECT node_id, prior FROM n ORDER BY prior DESC, node_id LIMIT 25")
def _(spark, d):
    return nodes(spark, d).orderBy(F.desc("prior"), "node_id").limit(25).select("node_id", "prior")


@query("top03_node_budget", N_E + ", k AS (SELECT id, count(*) AS k FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id ORDER BY k DESC, id LIMIT 60) SELECT source, target, count(*) AS n FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) GROUP BY 1, 2")
def _(spark, d):
    e = edges(spark, d)
    top = R.degrees(nodes(spark, d), e).filter("degree > 0").orderBy(F.desc("degree"), "node_id").limit(60)
    return R.within(e, top).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("top07_newest_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(15).select("o_orderkey", "o_orderdate")


@query("top09_partition_order", "SELECT label, count(*) AS size, dense_rank() OVER (ORDER BY count(*) DESC, min(vec_id)) AS partition_id FROM embeddings GROUP BY label")
def _(spark, d):
    sizes = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("size"), F.min("vec_id").alias("_first"))
    return sizes.withColumn("partition_id", F.dense_rank().over(Window.orderBy(F.desc("size"), "_first")).cast("bigint")).drop("_first")


@query("top10_canonical", "SELECT s_nationkey AS cluster, max_by(s_name, (length(s_name), s_acctbal, s_suppkey)) AS canonical FROM supplier GROUP BY 1")
def _(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("cluster")).agg(F.max_by("s_name", F.struct(F.length("s_name"), "s_acctbal", "s_suppkey")).alias("canonical"))
