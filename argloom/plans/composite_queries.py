"""Queries that combine operators: gates, evidence, tenability, posets, soft matching, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from argloom.functions import scores as S
from argloom.functions import text as T
from argloom.operators import graph as G
from argloom.operators import reachability
from argloom.operators import relational as R
from argloom.operators.iterate import cut
from argloom.plans.bindings import EDGES_SQL, NODES_SQL, PREDICTIONS_SQL, TRADE_SQL, edges, nodes, predictions, query, table, trade

TRADE = f"WITH RECURSIVE {TRADE_SQL.format(k=3)}"


@query("flt12_specialization_edges", "SELECT lower(replace(replace(p_type, ' ', '_'), '-', '_')) AS relation, count(*) AS n FROM part WHERE lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%steel%' GROUP BY 1")
def _(spark, d):
    name = T.local_name(F.concat(F.lit("str:"), F.replace(F.col("p_type"), F.lit(" "), F.lit("-"))))
    return table(spark, d, "part").filter(F.lower("p_type").rlike("brass|steel")).groupBy(F.lower(F.replace(name, F.lit("-"), F.lit("_"))).alias("relation")).agg(F.count("*").alias("n"))


@query("flt13_canonical_links", f"WITH {EDGES_SQL} SELECT DISTINCT source, target, CASE WHEN relation = 'attacks' THEN 'conflicts' ELSE 'coheres' END AS link FROM e WHERE relation IN ('attacks', 'supports')")
def _(spark, d):
    link = F.when(F.col("relation") == "attacks", "conflicts").otherwise("coheres")
    return edges(spark, d).filter(F.col("relation").isin("attacks", "supports")).select("source", "target", link.alias("link")).distinct()


@query(
    "flt15_model_classes",
    f"WITH {NODES_SQL}, {EDGES_SQL} SELECT node_id, class FROM (SELECT node_id, 'actual' AS class FROM n WHERE node_type = 'evidence' UNION SELECT node_id, 'potential' FROM n WHERE prior > 0.9 UNION SELECT target, 'partial' FROM e WHERE relation = 'supports' AND weight > 0.95) x",
)
def _(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    parts = [n.filter("node_type = 'evidence'").select("node_id", F.lit("actual").alias("class")), n.filter("prior > 0.9").select("node_id", F.lit("potential").alias("class")), e.filter("relation = 'supports' AND weight > 0.95").select(F.col("target").alias("node_id"), F.lit("partial").alias("class"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("flt17_bivariate_gate", f"WITH {EDGES_SQL} SELECT relation, count(*) AS n, round(sum(CASE WHEN coalesce(confidence, weight, 0.5) < 0.3 OR coalesce(weight, 0.5) < 0.2 THEN 0 ELSE weight * polarity END), 4) AS signed FROM e GROUP BY relation")
def _(spark, d):
    pruned = (F.coalesce("confidence", "weight", F.lit(0.5)) < 0.3) | (F.coalesce("weight", F.lit(0.5)) < 0.2)
    return edges(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum(F.when(pruned, 0.0).otherwise(F.col("weight") * F.col("polarity"))), 4).alias("signed"))


@query("flt21_borderline", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c), h AS (SELECT user_id, -sum(p * log2(p)) AS h, max(p) AS top FROM p GROUP BY user_id) SELECT user_id, round(h, 5) AS entropy FROM h WHERE h >= 0.7 OR top < 0.85")
def _(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    h = p.groupBy("user_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.max("p").alias("top"))
    return h.filter("h >= 0.7 OR top < 0.85").select("user_id", F.round("h", 5).alias("entropy"))


@query("flt24_view_mask", f"WITH {NODES_SQL}, {EDGES_SQL}, v AS (SELECT node_id FROM n WHERE (layer = 'L2' OR node_type IN ('claim', 'axiom')) AND contains(lower(name || ' ' || node_id || ' ' || node_type), '7')) SELECT source, target, count(*) AS n FROM e WHERE source IN (SELECT node_id FROM v) AND target IN (SELECT node_id FROM v) GROUP BY 1, 2")
def _(spark, d):
    n = nodes(spark, d)
    seen = n.filter(((F.col("layer") == "L2") | F.col("node_type").isin("claim", "axiom")) & F.lower(F.concat_ws(" ", "name", "node_id", "node_type")).contains("7"))
    return R.within(edges(spark, d), seen).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("flt28_violations", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT rule, count(*) AS n FROM (SELECT 'disjoint' AS rule FROM e GROUP BY source, target HAVING min(polarity) < max(polarity) UNION ALL SELECT 'type' FROM n WHERE node_type NOT IN ('claim', 'evidence', 'axiom')) x GROUP BY rule")
def _(spark, d):
    disjoint = edges(spark, d).groupBy("source", "target").agg((F.min("polarity") < F.max("polarity")).alias("both")).filter("both").select(F.lit("disjoint").alias("rule"))
    kind = nodes(spark, d).filter(~F.col("node_type").isin("claim", "evidence", "axiom")).select(F.lit("type").alias("rule"))
    return disjoint.unionByName(kind).groupBy("rule").agg(F.count("*").alias("n"))


@query("prj08_preview_rows", f"WITH {EDGES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN source IS NOT NULL AND target IS NOT NULL THEN 'relation' ELSE 'atom' END AS kind FROM e ORDER BY l_orderkey, l_linenumber LIMIT 50")
def _(spark, d):
    kind = F.when(F.col("source").isNotNull() & F.col("target").isNotNull(), "relation").otherwise("atom")
    return edges(spark, d).orderBy("l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("joi06_latest_enrichment", "WITH x AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT c_custkey, last FROM customer JOIN x ON user_id = c_custkey")
def _(spark, d):
    last = table(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return table(spark, d, "customer").join(last, "c_custkey").select("c_custkey", "last")


@query("joi12_cross_chunk_pairs", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority <> b.o_orderpriority AND year(a.o_orderdate) = year(b.o_orderdate)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderpriority")
    other = o.withColumnsRenamed({"o_orderkey": "b", "o_orderpriority": "q"})
    return o.join(other, ["o_custkey", "y"]).filter("o_orderkey < b AND o_orderpriority <> q").select(F.col("o_orderkey").alias("a"), "b")


@query("joi17_transitive_disjointness", TRADE + ", s AS (SELECT source, target FROM t WHERE (source + target) % 3 <> 0), k AS (SELECT source, target FROM t WHERE (source + target) % 3 = 0), p AS (SELECT a.source, b.target FROM s a JOIN s b ON a.target = b.source UNION SELECT a.source, c.target FROM s a JOIN s b ON a.target = b.source JOIN s c ON b.target = c.source UNION SELECT a.source, e.target FROM s a JOIN s b ON a.target = b.source JOIN s c ON b.target = c.source JOIN s e ON c.target = e.source) SELECT DISTINCT k.source AS source, k.target AS target FROM k JOIN p ON p.source = k.source AND p.target = k.target")
def _(spark, d):
    t = trade(spark, d)
    s, k = (t.filter(c).select("source", "target") for c in ("(source + target) % 3 <> 0", "(source + target) % 3 = 0"))
    step = lambda left: left.select("source", F.col("target").alias("via")).join(s.select(F.col("source").alias("via"), "target"), "via").select("source", "target").distinct()
    two = step(s)
    three = step(two)
    return k.join(two.unionByName(three).unionByName(step(three)).distinct(), ["source", "target"], "left_semi")


@query("joi21_config_diff", "WITH a AS (SELECT c_mktsegment || '.' || c_nationkey AS k, count(*)::VARCHAR AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_mktsegment || '.' || c_nationkey AS k, count(*)::VARCHAR AS v FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.k, b.k) AS key, coalesce(a.v, '-') AS before, coalesce(b.v, '-') AS after FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("key", F.concat_ws(".", "c_mktsegment", "c_nationkey"))
    side = lambda r, name: c.filter(F.col("c_custkey") % 2 == r).groupBy("key").agg(F.count("*").cast("string").alias(name))
    both = side(0, "before").join(side(1, "after"), "key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.na.fill("-")


@query("joi24_best_edge", f"WITH {EDGES_SQL}, g AS (SELECT source, target, max(weight) AS w FROM e WHERE epoch <= 1994 GROUP BY 1, 2), p AS (SELECT source, target, weight, polarity FROM e WHERE epoch > 1994) SELECT g.source AS source, g.target AS target, round(coalesce(max(0.5 + 0.3 * (p.polarity = 1)::INT + 0.2 * (1 - abs(p.weight - g.w))), 0), 5) AS score FROM g LEFT JOIN p ON p.source = g.source AND p.target = g.target GROUP BY 1, 2")
def _(spark, d):
    e = edges(spark, d)
    gold = e.filter("epoch <= 1994").groupBy("source", "target").agg(F.max("weight").alias("w"))
    both = gold.join(e.filter("epoch > 1994").select("source", "target", "weight", "polarity"), ["source", "target"], "left")
    score = 0.5 + 0.3 * (F.col("polarity") == 1).cast("int") + 0.2 * (1 - F.abs(F.col("weight") - F.col("w")))
    return both.groupBy("source", "target").agg(F.round(F.coalesce(F.max(score), F.lit(0.0)), 5).alias("score"))


@query("joi26_evidence_trail", "SELECT lang, CASE WHEN strpos(text, source) > 0 THEN 'exact' WHEN strpos(lower(text), lang) > 0 THEN 'substring' ELSE 'whole_chunk' END AS mode, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    mode = F.when(F.expr("locate(source, text)") > 0, "exact").when(F.expr("locate(lang, lower(text))") > 0, "substring").otherwise("whole_chunk")
    return table(spark, d, "documents").groupBy("lang", mode.alias("mode")).agg(F.count("*").alias("n"))


@query("agg16_grounding", f"WITH {PREDICTIONS_SQL} SELECT lang AS modality, round(avg(confidence), 6) AS mean_iou, count(*) FILTER (confidence >= 0.5) AS n_matched FROM pred GROUP BY lang")
def _(spark, d):
    return predictions(spark, d).groupBy(F.col("lang").alias("modality")).agg(F.round(F.avg("confidence"), 6).alias("mean_iou"), F.count_if(F.col("confidence") >= 0.5).alias("n_matched"))


@query("agg21_local_tenability", "SELECT l_suppkey, round(least(1, greatest(0, 1 - max(abs(l_discount - 0.05)) / 0.5)), 3) AS tenability FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(S.unit(1 - F.max(F.abs(F.col("l_discount") - 0.05)) / 0.5), 3).alias("tenability"))


@query("agg22_edge_tenability", f"WITH {EDGES_SQL}, p AS (SELECT source, relation, avg(weight) AS w FROM e GROUP BY 1, 2), q AS (SELECT target, relation, avg(weight) AS w FROM e GROUP BY 1, 2), k AS (SELECT DISTINCT source, target FROM e) SELECT k.source AS source, k.target AS target, round(max(abs(p.w - q.w)) + 1e-9, 4) AS tension FROM k JOIN p ON p.source = k.source JOIN q ON q.target = k.target AND q.relation = p.relation GROUP BY 1, 2")
def _(spark, d):
    e = cut(edges(spark, d).select("source", "target", "relation", "weight"))
    mean = lambda end, name: e.groupBy(end, "relation").agg(F.avg("weight").alias(name))
    joined = e.select("source", "target").distinct().join(mean("source", "p"), "source").join(mean("target", "q"), ["target", "relation"])
    return joined.groupBy("source", "target").agg(F.round(F.max(F.abs(F.col("p") - F.col("q"))) + 1e-9, 4).alias("tension"))


@query("agg26_strength_range", f"WITH {NODES_SQL} SELECT layer, round(avg(prior), 6) AS mean_strength, min(prior) AS low, max(prior) AS high FROM n GROUP BY layer")
def _(spark, d):
    return nodes(spark, d).groupBy("layer").agg(F.round(F.avg("prior"), 6).alias("mean_strength"), F.min("prior").alias("low"), F.max("prior").alias("high"))


@query("agg28_rank_reversals", "WITH x AS (SELECT s_nationkey AS k, avg(s_acctbal) AS a, sum(s_acctbal) AS b FROM supplier GROUP BY 1) SELECT count(*) AS n_pairs, count(*) FILTER ((x.a - y.a) * (x.b - y.b) < 0 AND abs(x.a - y.a) > 1e-4 AND abs(x.b - y.b) > 1e-4) AS n_reversals FROM x JOIN x y ON x.k < y.k")
def _(spark, d):
    # One row per nation on either side: a table of fixed size.
    x = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("a"), F.sum("s_acctbal").alias("b"))
    pairs = x.join(F.broadcast(x.select(F.col("k").alias("k2"), F.col("a").alias("a2"), F.col("b").alias("b2"))), F.expr("k < k2"))
    da, db = F.col("a") - F.col("a2"), F.col("b") - F.col("b2")
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if((da * db < 0) & (F.abs(da) > 1e-4) & (F.abs(db) > 1e-4)).alias("n_reversals"))


@query("agg32_benchmark_profile", "SELECT count(*) AS n_items, count(DISTINCT length(text)) AS n_lengths, max(length(text)) AS longest, count(*) FILTER (length(text) > 100) AS n_long FROM benchmark")
def _(spark, d):
    n = F.length("text")
    return table(spark, d, "benchmark").agg(F.count("*").alias("n_items"), F.count_distinct(n).alias("n_lengths"), F.max(n).cast("bigint").alias("longest"), F.count_if(n > 100).alias("n_long"))


@query("agg37_invalidation_preview", "SELECT min(l_linenumber)::BIGINT AS earliest_phase, sum(l_quantity)::BIGINT AS artifacts_lost FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def _(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F'").agg(F.min("l_linenumber").cast("bigint").alias("earliest_phase"), F.sum("l_quantity").cast("bigint").alias("artifacts_lost"))


@query("agg39_unmapped_in_newest_runs", "WITH r AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15) SELECT l_returnflag AS predicate, count(*) AS n, count(DISTINCT l_orderkey) AS n_runs FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM r) AND l_returnflag NOT IN ('A') GROUP BY 1")
def _(spark, d):
    newest = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(15).select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, d, "lineitem").join(newest, "l_orderkey", "left_semi").filter("l_returnflag <> 'A'")
    return rows.groupBy(F.col("l_returnflag").alias("predicate")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_runs"))


@query("scl04_default_polarity", f"WITH {EDGES_SQL} SELECT relation, CASE relation WHEN 'attacks' THEN -1 ELSE 1 END AS sign, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    return edges(spark, d).groupBy("relation", T.default_polarity(F.col("relation")).alias("sign")).agg(F.count("*").alias("n"))


@query("scl14_cell_iou", "WITH c AS (SELECT l_orderkey, list(DISTINCT l_linenumber || ':' || (l_quantity::INT % 3)) AS a, list(DISTINCT l_linenumber || ':' || (l_suppkey % 3)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS iou FROM c")
def _(spark, d):
    cell = lambda c: F.collect_set(F.concat_ws(":", "l_linenumber", c))
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(cell(F.col("l_quantity").cast("int") % 3).alias("a"), cell(F.col("l_suppkey") % 3).alias("b"))
    return c.select("l_orderkey", F.round(T.set_jaccard(F.col("a"), F.col("b")), 6).alias("iou"))


@query("scl23_envelope", "SELECT doc_id, md5(CASE WHEN strpos(text, '.') > 0 THEN substr(text, greatest(1, strpos(text, '.') - 20), least(20, strpos(text, '.') - 1)) || '[ENT].[\\ENT]' || substr(text, strpos(text, '.') + 1, 20) ELSE '' END) AS envelope FROM documents")
def _(spark, d):
    at = F.locate(".", "text")
    sub = lambda start, size: F.substring(F.col("text"), start, size)
    text = F.concat(sub(F.greatest(F.lit(1), at - 20), F.least(F.lit(20), at - 1)), F.lit("[ENT].[\\ENT]"), sub(at + 1, F.lit(20)))
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(F.when(at > 0, text).otherwise(""), "UTF-8")).alias("envelope"))


@query("mth04_f1", f"WITH {PREDICTIONS_SQL} SELECT source, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT source, CASE WHEN count(*) FILTER (confidence >= 0.3) = 0 THEN 0 ELSE count(*) FILTER (confidence >= 0.3 AND label = 1) / count(*) FILTER (confidence >= 0.3) END AS p, CASE WHEN count(*) FILTER (label = 1) = 0 THEN 0 ELSE count(*) FILTER (confidence >= 0.3 AND label = 1) / count(*) FILTER (label = 1) END AS r FROM pred GROUP BY source)")
def _(spark, d):
    hit, true = F.col("confidence") >= 0.3, F.col("label") == 1
    c = predictions(spark, d).groupBy("source").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit).alias("n_hit"), F.count_if(true).alias("n_true"))
    return c.select("source", F.round(S.f1(S.ratio(F.col("tp"), F.col("n_hit")), S.ratio(F.col("tp"), F.col("n_true"))), 6).alias("f1"))


@query("gra14_signed_paths", TRADE + ", g AS (SELECT source, target, CASE WHEN (source + target) % 3 = 0 THEN -1 ELSE 1 END AS p FROM t), r AS (SELECT source AS id, p AS sign, 1 AS k, [source, target] AS seen FROM g WHERE target = 7 UNION ALL SELECT g.source, r.sign * g.p, k + 1, list_append(seen, g.source) FROM r JOIN g ON g.target = r.id WHERE k < 2 AND NOT list_contains(seen, g.source)) SELECT id AS node_id, count(*) FILTER (sign = 1) AS n_support, count(*) FILTER (sign = -1) AS n_attack FROM r GROUP BY id")
def _(spark, d):
    g = trade(spark, d).select("source", "target", F.when((F.col("source") + F.col("target")) % 3 == 0, -1).otherwise(1).alias("p"))
    one = g.filter("target = 7").select(F.col("source").alias("id"), F.col("p").alias("sign"))
    two = one.join(g, F.col("id") == F.col("target")).filter("source <> 7 AND source <> id").select(F.col("source").alias("id"), (F.col("sign") * F.col("p")).alias("sign"))
    return one.unionByName(two).groupBy(F.col("id").alias("node_id")).agg(F.count_if(F.col("sign") == 1).alias("n_support"), F.count_if(F.col("sign") == -1).alias("n_attack"))


@query("gra21_provenance_edges", "SELECT l_partkey AS artifact, count(p_partkey) AS n_resolved, count(*) - count(p_partkey) AS n_unresolved FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1")
def _(spark, d):
    known = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("there"))
    return table(spark, d, "lineitem").join(known, "l_partkey", "left").groupBy(F.col("l_partkey").alias("artifact")).agg(F.count("there").alias("n_resolved"), F.count_if(F.col("there").isNull()).alias("n_unresolved"))


@query("gra28_auto_endpoints", f"WITH {NODES_SQL}, {EDGES_SQL}, k AS (SELECT node_id, prior FROM n WHERE prior < 0.9), x AS (SELECT source AS id FROM e UNION SELECT target FROM e) SELECT node_id, prior FROM k UNION ALL SELECT id, 0.5 FROM x WHERE id NOT IN (SELECT node_id FROM k)")
def _(spark, d):
    known = nodes(spark, d).filter("prior < 0.9").select("node_id", "prior")
    return known.unionByName(G.ends(edges(spark, d)).join(known, "node_id", "left_anti").withColumn("prior", F.lit(0.5)))


_TWO = TRADE + ", a AS (SELECT source, target FROM t WHERE source < target), b AS (SELECT source, target FROM t WHERE source < target AND (source + target) % 4 <> 0)"


@query("eva03_reduction_f1", _TWO + ", ra AS (SELECT source, target FROM a UNION SELECT r.source, a.target FROM ra r JOIN a ON r.target = a.source), rb AS (SELECT source, target FROM b UNION SELECT r.source, b.target FROM rb r JOIN b ON r.target = b.source), ta AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a x JOIN ra ON ra.source = x.target WHERE x.source = a.source AND ra.target = a.target)), tb AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b x JOIN rb ON rb.source = x.target WHERE x.source = b.source AND rb.target = b.target)) SELECT round(2 * (SELECT count(*) FROM ta JOIN tb USING (source, target)) / ((SELECT count(*) FROM ta) + (SELECT count(*) FROM tb)), 6) AS f1")
def _(spark, d):
    t = trade(spark, d).filter("source < target")
    return R.prf(reachability.reduction(t.filter("(source + target) % 4 <> 0")), reachability.reduction(t), ["source", "target"]).select(F.round("f1", 6).alias("f1"))


@query("eva04_reachability_f1", _TWO + ", ra AS (SELECT source, target FROM a UNION SELECT r.source, a.target FROM ra r JOIN a ON r.target = a.source), rb AS (SELECT source, target FROM b UNION SELECT r.source, b.target FROM rb r JOIN b ON r.target = b.source) SELECT round(2 * (SELECT count(*) FROM ra JOIN rb USING (source, target)) / ((SELECT count(*) FROM ra) + (SELECT count(*) FROM rb)), 6) AS f1")
def _(spark, d):
    t = cut(trade(spark, d).filter("source < target"))
    n = reachability.common_reach(t.filter("(source + target) % 4 <> 0"), t)
    return n.select(F.round(F.coalesce(F.try_divide(2 * F.col("n_both"), F.col("n_left") + F.col("n_right")), F.lit(0.0)), 6).alias("f1"))


_MODELS_SQL = "m AS (SELECT l_suppkey AS id, l_partkey AS model, CASE WHEN l_quantity = 50 AND l_discount = 0.10 AND l_returnflag = 'R' THEN 'actual' ELSE 'potential' END AS kind FROM lineitem), c AS (SELECT id, count(DISTINCT model) FILTER (kind = 'actual') AS n FROM m GROUP BY id), ax AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 9000)"


def subsumed(spark, d):
    """Specialization edges of the trade graph; a supplier's models are the parts it ships, the actual ones those of full, discounted returns."""
    actual = (F.col("l_quantity") == 50) & (F.col("l_discount") == 0.10) & (F.col("l_returnflag") == "R")
    models = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.when(actual, "actual").otherwise("potential").alias("kind"), F.col("l_partkey").alias("model"))
    axioms = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("node_id"))
    return reachability.subsumption(trade(spark, d).filter("source < target"), models, axioms)


@query("eva05_subsumption", f"{TRADE}, {_MODELS_SQL} SELECT source AS parent, target AS child, coalesce(p.n, 0) AS parent_actual, coalesce(k.n, 0) AS child_actual, coalesce(k.n, 0) > 0 OR target IN (SELECT id FROM ax) AS specializing, true AS compatible, coalesce(k.n, 0) > 0 OR target IN (SELECT id FROM ax) AS subsumed FROM t LEFT JOIN c p ON p.id = source LEFT JOIN c k ON k.id = target WHERE source < target")
def _(spark, d):
    return subsumed(spark, d)


@query(
    "eva02_poset_bundle",
    _TWO + f", {_MODELS_SQL}, ra AS (SELECT source, target FROM a UNION SELECT r.source, a.target FROM ra r JOIN a ON r.target = a.source), rb AS (SELECT source, target FROM b UNION SELECT r.source, b.target FROM rb r JOIN b ON r.target = b.source)"
    " SELECT 'reachability_f1' AS metric, round(2 * (SELECT count(*) FROM ra JOIN rb USING (source, target)) / ((SELECT count(*) FROM ra) + (SELECT count(*) FROM rb)), 6) AS value UNION ALL SELECT 'acyclic', CASE WHEN EXISTS (SELECT 1 FROM rb WHERE source = target) THEN 0.0 ELSE 1.0 END"
    " UNION ALL SELECT 'roots', (SELECT count(DISTINCT source) FROM b WHERE source NOT IN (SELECT target FROM b))::DOUBLE UNION ALL SELECT 'subsumption', (SELECT round(avg((coalesce(k.n, 0) > 0 OR target IN (SELECT id FROM ax))::INT), 6) FROM a LEFT JOIN c k ON k.id = target)",
)
def _(spark, d):
    gold = cut(trade(spark, d).filter("source < target"))
    pred = gold.filter("(source + target) % 4 <> 0")
    n = reachability.common_reach(pred, gold)
    row = lambda name, df, value: df.select(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    reach = row("reachability_f1", n, F.round(F.coalesce(F.try_divide(2 * F.col("n_both"), F.col("n_left") + F.col("n_right")), F.lit(0.0)), 6))
    acyclic = row("acyclic", reachability.on_cycles(pred).agg(F.count("*").alias("n")), (F.col("n") == 0).cast("int"))
    roots = row("roots", G.roots(pred).agg(F.count("*").alias("n")), F.col("n"))
    return reach.unionByName(acyclic).unionByName(roots).unionByName(row("subsumption", subsumed(spark, d).agg(F.avg(F.col("subsumed").cast("int")).alias("s")), F.round("s", 6)))


@query("eva15_extraction", f"WITH {NODES_SQL}, {EDGES_SQL}, p AS (SELECT DISTINCT coalesce(name, source) AS s, target, relation FROM e LEFT JOIN n ON node_id = source WHERE epoch <= 1996), g AS (SELECT DISTINCT coalesce(name, source) AS s, target, relation FROM e LEFT JOIN n ON node_id = source WHERE epoch >= 1996) SELECT (SELECT count(*) FROM p JOIN g USING (s, target, relation)) AS matched, (SELECT count(*) FROM p ANTI JOIN g USING (s, target, relation)) AS spurious, (SELECT count(*) FROM g ANTI JOIN p USING (s, target, relation)) AS omitted")
def _(spark, d):
    named = R.named_ends(edges(spark, d), nodes(spark, d))
    return R.prf(named.filter("epoch <= 1996"), named.filter("epoch >= 1996"), ["source_name", "target", "relation"]).select("matched", "spurious", "omitted")


@query("eva28_report", TRADE + ", v AS (SELECT DISTINCT id FROM (SELECT source AS id FROM t UNION ALL SELECT target FROM t)), r AS (SELECT source, target FROM t UNION SELECT r.source, t.target FROM r JOIN t ON r.target = t.source) SELECT (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM t) AS n_edges, (SELECT count(*) FROM r WHERE source = target) AS n_on_cycles")
def _(spark, d):
    t = trade(spark, d)
    one = R.graph_summary(G.ends(t), t).select("n_nodes", "n_edges")
    return one.join(F.broadcast(reachability.on_cycles(t).agg(F.count("*").alias("n_on_cycles"))), F.lit(True))
