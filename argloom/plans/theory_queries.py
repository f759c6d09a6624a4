"""Queries of theory-graph and record operators, bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from argloom.functions import text as T
from argloom.operators import graph as G
from argloom.operators import qbaf as Q
from argloom.operators import records as P
from argloom.operators import relational as R
from argloom.operators import theory as H
from argloom.plans.bindings import EDGES_SQL, NODES_SQL, PREDICTIONS_SQL, TRADE_SQL, edges, lines_and_orders, nodes, predictions, query, table, trade

#: What line items say of a relation, with gaps: nulls where a value was not given.
GIVEN_SQL = f"""{EDGES_SQL}, g AS (
  SELECT l_orderkey, l_linenumber, source, target, relation, polarity, confidence,
         CASE WHEN l_linenumber = 1 THEN weight END AS effective, CASE WHEN l_linenumber IN (1, 2) THEN 0.9::DOUBLE END AS active,
         CASE WHEN l_linenumber % 2 = 1 THEN weight / 2 END AS inferential, CASE WHEN l_linenumber = 4 THEN 0.8::DOUBLE END AS modal,
         CASE WHEN l_linenumber IN (3, 4) THEN confidence END AS stance, CASE WHEN l_linenumber < 7 THEN weight END AS weight FROM e)"""


def given(spark, d):
    n, w = F.col("l_linenumber"), F.col("weight")
    return edges(spark, d).select(
        "l_orderkey", "l_linenumber", "source", "target", "relation", "polarity", "confidence",
        F.when(n == 1, w).alias("effective"), F.when(n.isin(1, 2), 0.9).alias("active"), F.when(n % 2 == 1, w / 2).alias("inferential"),
        F.when(n == 4, 0.8).alias("modal"), F.when(n.isin(3, 4), F.col("confidence")).alias("stance"), F.when(n < 7, w).alias("weight"),
    )


PARTS = ("effective", "active", "inferential", "modal", "stance", "weight")
FORCE = "coalesce(inferential, modal, 1.0) * stance"


@query("qbf01_priors", f"WITH {NODES_SQL} SELECT node_id, round(least(1.0, greatest(0.0, coalesce(CASE WHEN nation % 3 = 0 THEN prior * 1.2 END, CASE WHEN nation % 3 = 1 THEN prior - 0.1 END, 0.5))), 6) AS tau FROM n")
def _(spark, d):
    base, confidence = F.when(F.col("nation") % 3 == 0, F.col("prior") * 1.2), F.when(F.col("nation") % 3 == 1, F.col("prior") - 0.1)
    return nodes(spark, d).select("node_id", F.round(H.prior(base, confidence), 6).alias("tau"))


@query(
    "qbf02_edge_weights",
    f"WITH {GIVEN_SQL} SELECT l_orderkey, l_linenumber, round(greatest(0.0, coalesce(effective, active, {FORCE}, inferential, weight, 1.0)), 6) AS typed, "
    f"round(greatest(0.0, coalesce(active, effective, {FORCE}, inferential, weight, 1.0)), 6) AS record FROM g",
)
def _(spark, d):
    parts = {c: F.col(c) for c in PARTS}
    return given(spark, d).select("l_orderkey", "l_linenumber", *(F.round(H.edge_weight(parts, typed), 6).alias(name) for name, typed in (("typed", True), ("record", False))))


@query("qbf02_missing_ends", f"WITH {NODES_SQL}, {EDGES_SQL}, k AS (SELECT node_id, prior AS tau FROM n WHERE nation % 2 = 0) SELECT node_id, round(tau, 6) AS tau FROM k UNION ALL SELECT node_id, 0.5 FROM (SELECT source AS node_id FROM e UNION SELECT target FROM e) WHERE node_id NOT IN (SELECT node_id FROM k)")
def _(spark, d):
    known = nodes(spark, d).filter("nation % 2 = 0").select("node_id", F.col("prior").alias("tau"))
    return H.with_missing_ends(known, edges(spark, d)).select("node_id", F.round("tau", 6).alias("tau"))


@query(
    "qbf08_admission",
    f"WITH {GIVEN_SQL}, a AS (SELECT *, coalesce(stance < 0.4, false) OR coalesce(confidence < 0.2, false) AS gone FROM g) SELECT relation, count(*) FILTER (NOT gone) AS n_kept, round(sum(CASE WHEN gone THEN 0 ELSE weight END), 3) AS hard, "
    "count(*) FILTER (NOT gone) * 1.0::DOUBLE AS binary, round(sum(weight * CASE WHEN stance IS NULL THEN 1 ELSE 1 / (1 + exp(-20 * (stance - 0.4))) END * CASE WHEN confidence IS NULL THEN 1 ELSE 1 / (1 + exp(-20 * (confidence - 0.2))) END), 3) AS soft FROM a GROUP BY relation",
)
def _(spark, d):
    g = given(spark, d).withColumn("accuracy", F.lit(None).cast("double"))
    total = lambda df, name: df.groupBy("relation").agg(F.sum("weight").alias(name))
    kept = H.admitted(g, stance=0.4, confidence=0.2)
    hard = kept.groupBy("relation").agg(F.count("*").alias("n_kept"), F.round(F.sum("weight"), 3).alias("hard"))
    binary = total(H.admitted(g, stance=0.4, confidence=0.2, binary=True, prune=False), "binary")
    soft = total(H.admitted(g, stance=0.4, confidence=0.2, soft=True), "soft")
    return hard.join(binary, "relation").join(soft, "relation").withColumn("soft", F.round("soft", 3))


@query(
    "qbf14_theory_projection",
    f"WITH {NODES_SQL}, {GIVEN_SQL}, w AS (SELECT source, target, polarity, greatest(0.0, coalesce(active, effective, {FORCE}, inferential, weight, 1.0)) AS weight FROM g WHERE NOT coalesce(stance < 0.4, false) AND NOT coalesce(confidence < 0.2, false)), "
    "r1 AS MATERIALIZED (SELECT node_id, prior AS tau, prior + (1 - prior) * s / (1 + s) - prior * a / (1 + a) AS x FROM (SELECT n.node_id, n.prior, coalesce(s, 0) AS s, coalesce(a, 0) AS a FROM n LEFT JOIN (SELECT target, sum(w.weight * p.prior) FILTER (polarity = 1) AS s, sum(w.weight * p.prior) FILTER (polarity = -1) AS a FROM w JOIN n p ON p.node_id = w.source GROUP BY target) f ON f.target = n.node_id)), "
    "r2 AS (SELECT node_id, tau + (1 - tau) * s / (1 + s) - tau * a / (1 + a) AS x FROM (SELECT r1.node_id, r1.tau, coalesce(s, 0) AS s, coalesce(a, 0) AS a FROM r1 LEFT JOIN (SELECT target, sum(w.weight * p.x) FILTER (polarity = 1) AS s, sum(w.weight * p.x) FILTER (polarity = -1) AS a FROM w JOIN r1 p ON p.node_id = w.source GROUP BY target) f ON f.target = r1.node_id)) "
    "SELECT node_id, round(least(1.0, greatest(0.0, x)), 5) AS strength FROM r2",
)
def _(spark, d):
    g = given(spark, d).withColumn("accuracy", F.lit(None).cast("double"))
    weighted = H.admitted(g, stance=0.4, confidence=0.2).withColumn("weight", H.edge_weight({c: F.col(c) for c in PARTS}, typed=False))
    n = nodes(spark, d).select("node_id", H.prior(F.col("prior")).alias("tau"))
    return Q.solve(n, weighted, "quadratic", rounds=2, tolerance=None, missing=0.5).select("node_id", F.round("strength", 5).alias("strength"))


#: Nodes of a reference and of a prediction that renames, retypes and moves some of them.
PAIRS_SQL = """ref AS (SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'actual_model' WHEN 'MACHINERY' THEN 'axiom' ELSE 'claim' END AS type,
  c_nationkey AS status, c_custkey % 3 = 0 AS has_axiom, c_custkey % 4 = 0 AS has_anchor, c_acctbal / 10000 AS overlap FROM customer),
pred AS (SELECT id, CASE WHEN id % 5 = 0 THEN name || ' copy' ELSE name END AS p_name, CASE WHEN id % 7 = 0 THEN 'axiom' ELSE type END AS p_type, CASE WHEN id % 6 = 0 THEN 0 ELSE status END AS p_status FROM ref),
part AS (SELECT ref.*, CASE WHEN type = p_type THEN 1.0 WHEN type IN ('actual_model', 'axiom') AND p_type IN ('actual_model', 'axiom') THEN 0.95 ELSE 0.0 END AS t, CASE WHEN status = p_status THEN 1.0 ELSE 0.5 END AS s,
  CASE WHEN id % 5 = 0 THEN 0.5 ELSE 1.0 END AS nm, least(1.0, greatest(0.0, overlap)) AS o FROM ref JOIN pred USING (id))"""


def pairs(spark, d):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    ref = table(spark, d, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.when(segment == "BUILDING", "actual_model").when(segment == "MACHINERY", "axiom").otherwise("claim").alias("type"),
        F.col("c_nationkey").alias("status"),
        (key % 3 == 0).alias("has_axiom"),
        (key % 4 == 0).alias("has_anchor"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000)).alias("overlap"),
    )
    i = F.col("id")
    pred = ref.select("id", F.when(i % 5 == 0, F.concat("name", F.lit(" copy"))).otherwise(F.col("name")).alias("p_name"), F.when(i % 7 == 0, "axiom").otherwise(F.col("type")).alias("p_type"), F.when(i % 6 == 0, 0).otherwise(F.col("status")).alias("p_status"))
    return ref.join(pred, "id")


def similarity(same_id):
    parts = {"type": H.type_similarity(F.col("type"), F.col("p_type")), "status": F.when(F.col("status") == F.col("p_status"), 1.0).otherwise(0.5), "name": H.name_similarity(F.col("name"), F.col("p_name"), same_id), "axiom": F.col("overlap"), "anchor": F.col("overlap")}
    return parts, H.node_similarity(parts, F.col("has_axiom"), F.col("has_anchor"), same_id)


@query(
    "scl17_node_similarity",
    f"WITH {PAIRS_SQL} SELECT id, round(CASE WHEN has_axiom AND has_anchor THEN 0.35 * o + 0.25 * nm + 0.2 * o + 0.1 * t + 0.1 * s WHEN has_axiom THEN 0.45 * o + 0.25 * nm + 0.15 * t + 0.15 * s "
    "WHEN has_anchor THEN 0.35 * o + 0.35 * nm + 0.15 * t + 0.15 * s ELSE 0.5 * nm + 0.3 * t + 0.2 * s END, 6) AS similarity FROM part",
)
def _(spark, d):
    # The ids agree here, so the blend is shown without the floor that they give.
    p = pairs(spark, d).withColumn("name", F.regexp_replace("name", " ", "_")).withColumn("p_name", F.regexp_replace("p_name", "(?<!copy) (?!copy)", "_"))
    return p.select("id", F.round(similarity(F.lit(False))[1], 6).alias("similarity"))


@query(
    "agg25_fidelity",
    f"WITH {PAIRS_SQL}, m AS (SELECT *, greatest(0.85, CASE WHEN has_axiom AND has_anchor THEN 0.35 * o + 0.25 * nm + 0.2 * o + 0.1 * t + 0.1 * s WHEN has_axiom THEN 0.45 * o + 0.25 * nm + 0.15 * t + 0.15 * s WHEN has_anchor THEN 0.35 * o + 0.35 * nm + 0.15 * t + 0.15 * s ELSE 0.5 * nm + 0.3 * t + 0.2 * s END) >= 0.9 AS hit FROM part) "
    "SELECT round(count(*) FILTER (hit) / count(*), 6) AS mcc, round(count(*) FILTER (NOT hit AND type = 'actual_model') / count(*) FILTER (type = 'actual_model'), 6) AS aor, "
    "round(avg(t) FILTER (hit), 6) AS type_fidelity, round(avg(s) FILTER (hit), 6) AS status_fidelity FROM m",
)
def _(spark, d):
    p = pairs(spark, d).withColumn("name", F.regexp_replace("name", " ", "_")).withColumn("p_name", F.regexp_replace("p_name", "(?<!copy) (?!copy)", "_"))
    parts, whole = similarity(F.lit(True))
    scored = p.select("id", F.col("type").alias("class"), parts["type"].alias("t"), parts["status"].alias("s"), whole.alias("similarity"))
    hit = scored.filter("similarity >= 0.9")
    score = H.completeness(scored.select(F.col("id").alias("node_id"), "class"), hit.select(F.col("id").alias("node_id")))
    means = hit.agg(F.round(F.avg("t"), 6).alias("type_fidelity"), F.round(F.avg("s"), 6).alias("status_fidelity"))
    return score.select(F.round("mcc", 6).alias("mcc"), F.round("aor", 6).alias("aor")).join(F.broadcast(means), F.lit(True))


@query(
    "mth09_edge_fidelity",
    f"WITH {EDGES_SQL}, r AS (SELECT source, target, relation, max(polarity) AS polarity, sum(weight) AS weight FROM e WHERE epoch < 1998 GROUP BY 1, 2, 3), p AS (SELECT source, target, relation, max(polarity) AS polarity, sum(weight) AS weight FROM e WHERE epoch >= 1998 GROUP BY 1, 2, 3), "
    "k AS (SELECT r.source, r.target, r.relation, max(CASE WHEN p.source IS NULL THEN 0 ELSE 0.5 * CASE WHEN r.relation = p.relation THEN 1 ELSE 0.5 END + 0.3 * CASE WHEN r.polarity = p.polarity THEN 1 ELSE 0 END + 0.2 * greatest(0, 1 - abs(r.weight - p.weight) / greatest(r.weight, 1)) END) AS f FROM r LEFT JOIN p ON r.source = p.source AND r.target = p.target AND CAST(substr(r.source, 2) AS INT) % 5 <> 0 GROUP BY 1, 2, 3) "
    "SELECT relation, count(*) AS n, round(avg(coalesce(f, 0)), 5) AS fidelity FROM k GROUP BY relation",
)
def _(spark, d):
    e = edges(spark, d)
    run = lambda c: e.filter(c).groupBy("source", "target", "relation").agg(F.max("polarity").alias("polarity"), F.sum("weight").alias("weight"))
    known = nodes(spark, d).filter("NOT (node_id LIKE 's%' AND CAST(substring(node_id, 2) AS INT) % 5 = 0)").select("node_id", F.col("node_id").alias("match"))
    best = H.best_edge_fidelity(run("epoch < 1998"), run("epoch >= 1998"), known)
    return best.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("fidelity"), 5).alias("fidelity"))


PARAMS_SQL = "par AS (SELECT 's' || ps_suppkey AS node_id, 'p' || ps_partkey % 5 AS name, avg(ps_supplycost / 1000) AS value FROM (SELECT l_suppkey AS ps_suppkey, l_partkey AS ps_partkey, l_extendedprice / l_quantity / 3 AS ps_supplycost FROM lineitem) GROUP BY 1, 2)"


def params(spark, d):
    cost = F.col("l_extendedprice") / F.col("l_quantity") / 3 / 1000
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("node_id"), F.concat(F.lit("p"), F.col("l_partkey") % 5).alias("name")).agg(F.avg(cost).alias("value"))


def trade_names(spark, d):
    return trade(spark, d).select(F.concat(F.lit("s"), "source").alias("source"), F.concat(F.lit("s"), "target").alias("target"))


TEN_SQL = f"WITH {TRADE_SQL.format(k=3)}, {PARAMS_SQL}, x AS (SELECT t.source, t.target, max(abs(a.value - b.value)) AS delta FROM t LEFT JOIN par a ON a.node_id = 's' || t.source LEFT JOIN par b ON b.node_id = 's' || t.target AND b.name = a.name GROUP BY 1, 2), y AS (SELECT source, target, least(1.0, greatest(0.0, 1 - coalesce(delta, 0))) AS ts FROM x)"


@query("agg20_mean_parameter", f"WITH {NODES_SQL}, {PARAMS_SQL} SELECT n.node_id AS node_id, round(coalesce(avg(value), 0.5), 5) AS mean FROM n LEFT JOIN par ON par.node_id = n.node_id AND par.name IN ('p1', 'p2') GROUP BY 1")
def _(spark, d):
    measured = params(spark, d).filter(F.col("name").isin("p1", "p2")).groupBy("node_id").agg(F.avg("value").alias("mean"))
    return nodes(spark, d).select("node_id").join(measured, "node_id", "left").select("node_id", F.round(F.coalesce("mean", F.lit(0.5)), 5).alias("mean"))


@query("agg22_tenability_of_edges", TEN_SQL + " SELECT 's' || source AS source, 's' || target AS target, round(ts, 3) AS tenability, ts < 0.5 AS anomaly FROM y")
def _(spark, d):
    return H.edge_tenability(trade_names(spark, d), params(spark, d))


@query("agg23_theory_tenability", TEN_SQL + f", {NODES_SQL}, z AS (SELECT 's' || source AS node_id, avg(round(ts, 3)) AS edge FROM y GROUP BY 1) SELECT n.node_id AS node_id, round(0.6 * prior + 0.4 * coalesce(edge, 1.0), 3) AS tenability, round(0.6 * prior + 0.4 * coalesce(edge, 1.0), 3) >= 0.5 AS tenable FROM n LEFT JOIN z ON n.node_id = z.node_id")
def _(spark, d):
    scores = H.edge_tenability(trade_names(spark, d), params(spark, d))
    return H.theory_tenability(nodes(spark, d).select("node_id", F.col("prior").alias("score")), scores, 0.6, 0.4)


@query("agg33_theory_lens", f"WITH {NODES_SQL} SELECT nation AS theory, count(*) AS n_nodes, count(DISTINCT node_type) AS n_clusters, round(avg(prior), 6) AS tenability FROM n GROUP BY nation")
def _(spark, d):
    return nodes(spark, d).groupBy(F.col("nation").alias("theory")).agg(F.count("*").alias("n_nodes"), F.countDistinct("node_type").alias("n_clusters"), F.round(F.avg("prior"), 6).alias("tenability"))


@query(
    "mth06_metric_winners",
    "WITH m AS (SELECT CASE event_type WHEN 'error' THEN 'error_rate' WHEN 'click' THEN 'latency' ELSE event_type || '_f1' END AS metric, round(avg(value) FILTER (user_id % 2 = 0), 2) AS a, round(avg(value) FILTER (user_id % 2 = 1), 2) AS b FROM events GROUP BY 1) "
    "SELECT metric, CASE WHEN a = b THEN 'tie' WHEN (a > b) <> (metric IN ('error_rate', 'latency')) THEN 'a' ELSE 'b' END AS winner FROM m",
)
def _(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "error", "error_rate").when(kind == "click", "latency").otherwise(F.concat(kind, F.lit("_f1")))
    m = table(spark, d, "events").groupBy(name.alias("metric")).agg(*(F.round(F.avg(F.when(F.col("user_id") % 2 == k, F.col("value"))), 2).alias(c) for k, c in enumerate("ab")))
    return m.select("metric", H.metric_winner(F.col("metric"), F.col("a"), F.col("b")).alias("winner"))


@query("mth01_unit", "SELECT c_custkey AS id, least(1.0, greatest(0.0, c_acctbal / 5000)) AS clipped FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), H.unit(F.col("c_acctbal") / 5000).alias("clipped"))


# Writes


@query(
    "mut02_upsert_relations",
    f"WITH {NODES_SQL}, {EDGES_SQL}, cur AS (SELECT source, target, relation, max(weight) AS weight FROM e WHERE epoch < 1996 GROUP BY 1, 2, 3), inc AS (SELECT source, target, relation, max(weight) AS weight FROM e WHERE epoch >= 1996 AND source IN (SELECT node_id FROM n WHERE nation % 2 = 0) AND target IN (SELECT node_id FROM n WHERE nation % 2 = 0) GROUP BY 1, 2, 3) "
    "SELECT coalesce(inc.source, cur.source) AS source, coalesce(inc.target, cur.target) AS target, coalesce(inc.relation, cur.relation) AS relation, round(coalesce(inc.weight, cur.weight), 6) AS weight FROM cur FULL JOIN inc ON cur.source = inc.source AND cur.target = inc.target AND cur.relation = inc.relation",
)
def _(spark, d):
    e = edges(spark, d)
    part = lambda c: e.filter(c).groupBy("source", "target", "relation").agg(F.round(F.max("weight"), 6).alias("weight"))
    return P.upsert_relations(part("epoch < 1996"), part("epoch >= 1996"), nodes(spark, d).filter("nation % 2 = 0"))


BATCH_SQL = "tr AS (SELECT l_orderkey AS item, l_partkey AS object FROM lineitem), done AS (SELECT o_orderkey AS item FROM orders WHERE o_orderstatus = 'F')"


def batch(spark, d):
    line, orders = lines_and_orders(spark, d)
    line = line.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("object"))
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item"))
    return line, done


@query("mut07_batch_commit", f"WITH {BATCH_SQL} SELECT item, count(*) AS n_triples, count(*) FILTER (NOT old) > 0 AS committed FROM (SELECT item, object, item IN (SELECT item FROM done) AS old FROM tr) GROUP BY item")
def _(spark, d):
    line, done = batch(spark, d)
    stored = line.join(done, "item", "left_semi")
    triples, after = P.commit_batch(stored, line, done, "item")
    triples, after = P.commit_batch(triples, line, after, "item")  # the same batch again changes nothing
    return triples.groupBy("item").agg(F.count("*").alias("n_triples")).join(after.join(done, "item", "left_anti").withColumn("new", F.lit(True)), "item", "left").select("item", "n_triples", F.coalesce("new", F.lit(False)).alias("committed"))


@query("mut08_cleared_checkpoints", "SELECT user_id AS item, event_type AS phase, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1, 2")
def _(spark, d):
    return P.cleared(table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("phase")), "click").groupBy("item", "phase").agg(F.count("*").alias("n"))


@query("mut10_serialized_properties", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 3 END AS n_properties, '{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS nested FROM customer")
def _(spark, d):
    name = F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    props = P.serialized({"name": name, "segment": F.col("c_mktsegment")}, {"home": F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))})
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), props.alias("p")).select("id", F.size("p").alias("n_properties"), F.col("p")["home"].alias("nested"))


@query(
    "mut11_adjudications",
    "WITH a AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS verdict FROM events GROUP BY 1), g AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0) SELECT id, 'gold' AS origin FROM g UNION ALL SELECT id, 'adjudicated' FROM a WHERE verdict = 'purchase' AND id NOT IN (SELECT id FROM g)",
)
def _(spark, d):
    e = table(spark, d, "events")
    verdicts = e.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verdict"))
    gold = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    right = verdicts.filter("verdict = 'purchase'").select("id").join(gold, "id", "left_anti")
    return gold.withColumn("origin", F.lit("gold")).unionByName(right.withColumn("origin", F.lit("adjudicated")))


# Lineage: an order's parent is the customer's order before it.

RUNS_SQL = "run AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders), up AS (SELECT id, id AS ancestor, 0 AS depth FROM run UNION ALL SELECT up.id, run.parent, depth + 1 FROM up JOIN run ON run.id = up.ancestor WHERE run.parent IS NOT NULL AND depth < 64)"


def runs(spark, d):
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(before).alias("parent"))


@query("gra25_lineage", f"WITH RECURSIVE {RUNS_SQL} SELECT id, max(depth) AS depth, min(ancestor) AS least, count(*) AS n FROM up GROUP BY id")
def _(spark, d):
    return P.lineage(runs(spark, d), "id", "parent").groupBy("id").agg(F.max("depth").alias("depth"), F.min("ancestor").alias("least"), F.count("*").alias("n"))


@query("win09_lineage_dedupe", f"WITH RECURSIVE {RUNS_SQL}, env AS (SELECT DISTINCT l_orderkey AS run_id, 'k' || l_partkey % 7 AS identity_key FROM lineitem) SELECT up.id AS id, identity_key, arg_min(run_id, depth) AS run_id FROM up JOIN env ON run_id = ancestor GROUP BY 1, 2")
def _(spark, d):
    envelopes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("k"), F.col("l_partkey") % 7).alias("identity_key")).distinct()
    return P.first_of_lineage(P.lineage(runs(spark, d), "id", "parent"), envelopes)


@query("gra22_stale_by_kind", "SELECT o_orderpriority AS kind, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def _(spark, d):
    stale = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    return P.stale_map(stale, "kind").select("kind", "n", F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"))


@query("gra29_interdomain_digraph", f"WITH {EDGES_SQL} SELECT source AS head, target AS tail, arg_max(relation, (l_orderkey * 10 + l_linenumber, relation)) AS relation FROM e WHERE confidence IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    e = edges(spark, d).select(F.when(F.col("confidence").isNotNull(), F.col("source")).alias("head"), F.col("target").alias("tail"), "relation", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return P.last_relation(e, "at")


# Records and texts


@query("scl25_fingerprints", "SELECT c_custkey AS id, sha256('{\"balance\":' || CAST(c_nationkey AS VARCHAR) || ',\"name\":\"' || c_name || '\"}') AS fingerprint FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), P.fingerprint(F.struct(F.col("c_nationkey").alias("balance"), F.col("c_name").alias("name"))).alias("fingerprint"))


@query("scl27_flattened", "SELECT c_custkey AS id, unnest(['home.nation', 'home.segment.name', 'title']) AS path, unnest([CAST(c_nationkey AS VARCHAR), c_mktsegment, c_name]) AS value FROM customer")
def _(spark, d):
    home = F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_mktsegment").alias("name")).alias("segment"))
    return P.flattened(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), home.alias("home"), F.col("c_name").alias("title")), "id")


@query("scl30_subgraph_text", f"WITH {NODES_SQL} SELECT nation, string_agg(DISTINCT name || ' (' || node_type || ')', chr(10) ORDER BY name || ' (' || node_type || ')') AS text FROM n GROUP BY nation")
def _(spark, d):
    line = F.format_string("%s (%s)", "name", "node_type")
    return nodes(spark, d).groupBy("nation").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("text"))


@query("win12_recent_distinct", "WITH x AS (SELECT user_id, event_type || '-' || (event_id % 40) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, item, min(i) AS i FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM f) SELECT user_id, string_agg(item, ',' ORDER BY i) AS items FROM r WHERE k <= 15 GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", F.concat("event_type", F.lit("-"), F.col("event_id") % 40).alias("item")).alias("x"))
    items = e.groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return items.select("user_id", F.array_join(P.bounded_distinct(F.col("x.item")), ",").alias("items"))


@query("scl02_epistemic_status", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'hard_core' WHEN p_partkey % 4 = 1 THEN 'protective_belt' WHEN p_partkey % 4 = 2 THEN 'anomalous' ELSE 'neutral' END AS status FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "es:HardCore").when(k == 1, " auxiliary ").when(k == 2, "Anomaly").otherwise(F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.epistemic_status(raw).alias("status"))


@query("scl09_scope_type", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'essentieller_allsatz' WHEN 1 THEN 'lokalisierter_existenzsatz' WHEN 2 THEN 'statistischer_allsatz' WHEN 3 THEN 'existenzsatz' END AS scope FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "Ein essentieller Allsatz").when(k == 1, "lokalisierter Existenzsatz").when(k == 2, "probabilistisch/statistisch").when(k == 3, "existenzsatz").otherwise(F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.scope_type(raw).alias("scope"))


# Selections and joins


@query("prj01_without_embeddings", "SELECT vec_id, label FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").drop("embedding")


@query("flt18_theory_edges", f"WITH {NODES_SQL}, {EDGES_SQL}, a AS (SELECT node_id FROM n WHERE node_type IN ('claim', 'axiom')) SELECT relation, count(*) AS n FROM e WHERE (source IN (SELECT node_id FROM a) AND target IN (SELECT node_id FROM a)) OR relation = 'supports' OR weight > 0.95 OR ((source IN (SELECT node_id FROM a) OR target IN (SELECT node_id FROM a)) AND relation <> 'explains') GROUP BY relation")
def _(spark, d):
    atoms = nodes(spark, d).filter("node_type IN ('claim', 'axiom')").select("node_id")
    e = edges(spark, d)
    for end in ("source", "target"):
        e = e.join(atoms.select(F.col("node_id").alias(end), F.lit(True).alias(f"{end}_atom")), end, "left").fillna(False, f"{end}_atom")
    return e.filter("(source_atom AND target_atom) OR relation = 'supports' OR weight > 0.95 OR ((source_atom OR target_atom) AND relation <> 'explains')").groupBy("relation").agg(F.count("*").alias("n"))


@query("flt22_reports_by_run", "WITH r AS (SELECT o_custkey AS report, list(DISTINCT o_orderpriority) AS runs, max(o_orderstatus) AS outcome FROM orders GROUP BY 1) SELECT report, outcome FROM r WHERE (list_contains(runs, '1-URGENT') OR list_contains(runs, '2-HIGH')) AND outcome = 'P'")
def _(spark, d):
    reports = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("report")).agg(F.collect_set("o_orderpriority").alias("runs"), F.max("o_orderstatus").alias("outcome"))
    return reports.filter(F.arrays_overlap("runs", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))) & (F.col("outcome") == "P")).select("report", "outcome")


@query("joi15_mapped_predictions", f"WITH {NODES_SQL}, {EDGES_SQL}, m AS (SELECT node_id, 'g' || node_id AS gold FROM n WHERE nation < 20) SELECT coalesce(a.gold, e.source) AS source, coalesce(b.gold, e.target) AS target, count(*) AS n FROM e LEFT JOIN m a ON a.node_id = e.source LEFT JOIN m b ON b.node_id = e.target GROUP BY 1, 2")
def _(spark, d):
    gold = nodes(spark, d).filter("nation < 20").select("node_id", F.concat(F.lit("g"), "node_id").alias("gold"))
    e = edges(spark, d).select("source", "target")
    for end in ("source", "target"):
        e = e.join(gold.withColumnsRenamed({"node_id": end, "gold": "_gold"}), end, "left").withColumn(end, F.coalesce("_gold", end)).drop("_gold")
    return e.groupBy("source", "target").agg(F.count("*").alias("n"))


@query("joi23_gold_targets", "WITH g AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS node FROM lineitem), t AS (SELECT p_partkey AS q, 'n' || p_partkey AS target FROM part) SELECT count(*) AS n, count(DISTINCT target) AS n_targets FROM (SELECT q, target FROM t UNION SELECT node, 'c' || chunk FROM g)")
def _(spark, d):
    mentions = table(spark, d, "lineitem").select(F.col("l_partkey").alias("q"), F.concat(F.lit("c"), "l_orderkey").alias("target"))
    own = table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.concat(F.lit("n"), "p_partkey").alias("target"))
    return own.unionByName(mentions).distinct().agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"))


@query("joi28_target_params", "SELECT l_partkey AS cluster, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey, l_discount)) AS theory, round(arg_min(l_discount, (l_orderkey, l_linenumber, l_suppkey, l_discount)), 4) AS value FROM lineitem GROUP BY 1")
def _(spark, d):
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cluster")).agg(F.min_by("l_suppkey", order).alias("theory"), F.round(F.min_by("l_discount", order), 4).alias("value"))


@query("joi29_adjudicated_edges", f"WITH {EDGES_SQL}, k AS (SELECT source, target, max(weight) AS w FROM e GROUP BY 1, 2), a AS (SELECT 's' || l_suppkey AS source, 'c' || o_custkey AS target, 'tp' AS verdict FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1, 2) SELECT coalesce(verdict, 'open') AS verdict, count(*) AS n, round(avg(w), 5) AS weight FROM k LEFT JOIN a USING (source, target) GROUP BY 1")
def _(spark, d):
    e = edges(spark, d).groupBy("source", "target").agg(F.max("weight").alias("w"))
    line = table(spark, d, "lineitem").filter("l_linestatus = 'F'").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    verdicts = line.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"), F.lit("tp").alias("verdict")).distinct()
    return e.join(verdicts, ["source", "target"], "left").groupBy(F.coalesce("verdict", F.lit("open")).alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg("w"), 5).alias("weight"))


@query("ret01_search_corpus", f"WITH {NODES_SQL} SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'document' AS kind, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'node', name FROM n UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY kind")
def _(spark, d):
    every = [table(spark, d, "documents").select(F.lit("document").alias("kind"), F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), nodes(spark, d).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("name").alias("text")), table(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.concat(F.lit("b"), "item_id").alias("id"), "text")]
    return P.first_source(every).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("ret02_candidate_precedence", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'entity' ELSE 'chunk' END AS label FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return P.first_source([c.filter("id % 2 = 0").withColumn("label", F.lit("entity")), c.withColumn("label", F.lit("chunk"))])


@query("top05_representatives", None)
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    centre = v.groupBy("label", "i").agg(F.avg("x").alias("m"))
    near = v.join(centre, ["label", "i"]).groupBy("vec_id", "label").agg((F.sum(F.col("x") * F.col("m")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("m") * F.col("m")))).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("cosine", 6)), "vec_id"))
    return near.withColumn("rank", rank).filter("rank <= 3").select("label", "rank", "vec_id")


@query("agg17_macro_metrics", f"WITH {PREDICTIONS_SQL}, q AS (SELECT source, count(*) FILTER (confidence >= 0.5 AND label = 1) / greatest(1, count(*) FILTER (confidence >= 0.5)) AS p, count(*) FILTER (confidence >= 0.5 AND label = 1) / greatest(1, count(*) FILTER (label = 1)) AS r FROM pred GROUP BY source) SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, count(*) AS n FROM q")
def _(spark, d):
    found, right = F.col("confidence") >= 0.5, F.col("label") == 1
    share = lambda a, b: F.count_if(a) / F.greatest(F.lit(1), F.count_if(b))
    q = predictions(spark, d).groupBy("source").agg(share(found & right, found).alias("p"), share(found & right, right).alias("r"))
    return q.agg(F.round(F.avg("p"), 6).alias("macro_precision"), F.round(F.avg("r"), 6).alias("macro_recall"), F.count("*").alias("n"))


@query("eva23_run_diff", f"WITH {EDGES_SQL}, a AS (SELECT DISTINCT source, target FROM e WHERE epoch < 1998), b AS (SELECT DISTINCT source, target FROM e WHERE epoch >= 1998) SELECT coalesce(CASE WHEN a.source IS NULL THEN 'gained' WHEN b.source IS NULL THEN 'lost' END, 'retained') AS change, count(*) AS n, count(DISTINCT coalesce(a.source, b.source)) AS n_sources FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target GROUP BY 1")
def _(spark, d):
    e = edges(spark, d)
    run = lambda c, side: e.filter(c).select("source", "target").distinct().withColumn(side, F.lit(True))
    both = run("epoch < 1998", "before").join(run("epoch >= 1998", "after"), ["source", "target"], "full")
    change = F.when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "lost").otherwise("retained")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


@query("gra23_similar_components", f"WITH RECURSIVE {TRADE_SQL.format(k=2)}, u AS (SELECT source AS a, target AS b FROM t UNION SELECT target, source FROM t), r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT component, count(*) AS n FROM (SELECT id, min(c) AS component FROM r GROUP BY id) GROUP BY component")
def _(spark, d):
    return G.components(trade(spark, d, 2)).groupBy("component").agg(F.count("*").alias("n"))


@query("src18_labelled_export", f"WITH {NODES_SQL} SELECT node_id, CASE WHEN node_type = 'axiom' THEN 'hard_core' WHEN layer = 'L2' THEN 'protective_belt' ELSE 'neutral' END AS status, layer FROM n")
def _(spark, d):
    n = nodes(spark, d)
    layer = lambda which: n.filter(F.col("layer") == which).select("node_id", F.when(F.col("node_type") == "axiom", "hard_core").otherwise("protective_belt" if which == "L2" else "neutral").alias("status"), "layer")
    return layer("L2").unionByName(layer("L3"))


@query("src24_active_learning", f"WITH {PREDICTIONS_SQL} SELECT doc_id, coalesce(CASE WHEN doc_id % 10 = 0 THEN label END, CASE WHEN doc_id % 3 = 0 THEN 1 END, CAST(confidence > 0.5 AS INT)) AS target FROM pred")
def _(spark, d):
    i = F.col("doc_id")
    return predictions(spark, d).select("doc_id", F.coalesce(F.when(i % 10 == 0, F.col("label")), F.when(i % 3 == 0, 1), (F.col("confidence") > 0.5).cast("int")).alias("target"))


@query("dec03_pair_gate", f"WITH {EDGES_SQL}, p AS (SELECT source, target, max(weight) AS w FROM e GROUP BY 1, 2) SELECT CASE WHEN w >= 0.9 THEN 'accept' WHEN w < 0.4 AND substr(md5(source || '|' || target), 1, 1) IN ('0', '1') THEN 'audit' WHEN w < 0.4 THEN 'reject' ELSE 'verify' END AS decision, count(*) AS n FROM p GROUP BY 1")
def _(spark, d):
    pair = edges(spark, d).groupBy("source", "target").agg(F.max("weight").alias("w"))
    return pair.groupBy(R.gate_decision(F.col("w"), F.concat_ws("|", "source", "target"), 0.9, 0.4).alias("decision")).agg(F.count("*").alias("n"))


@query("dec06_choice", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c), b AS (SELECT user_id, max(p) AS top, arg_max(event_type, (p, event_type)) AS best FROM p GROUP BY 1) SELECT user_id, CASE WHEN top >= 0.3 THEN best ELSE 'abstain' END AS choice FROM b")
def _(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    best = p.groupBy("user_id").agg(F.max("p").alias("top"), F.max_by("event_type", F.struct("p", "event_type")).alias("best"))
    return best.select("user_id", F.when(F.col("top") >= 0.3, F.col("best")).otherwise("abstain").alias("choice"))
