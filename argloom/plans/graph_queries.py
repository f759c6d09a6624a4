"""Queries of graph and argumentation operators on the trade graph of one order year.

Iterative operators run a fixed number of rounds here, so that unrolled SQL gives the same result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from argloom.operators import communities as C
from argloom.operators import graph as G
from argloom.operators import qbaf as Q
from argloom.operators import reachability as R
from argloom.operators.iterate import cut
from argloom.plans.bindings import TRADE_SQL, query, trade

T = f"WITH RECURSIVE {TRADE_SQL.format(k=3)}"
T2 = f"WITH RECURSIVE {TRADE_SQL.format(k=2)}"
DAG = ", d AS (SELECT source, target, weight FROM t WHERE source < target)"
NODES = ", v AS (SELECT DISTINCT id FROM (SELECT source AS id FROM t UNION ALL SELECT target FROM t))"
SIGNED = ", a AS (SELECT source, target, weight / (SELECT max(weight) FROM t) AS w, CASE WHEN (source + target) % 3 = 0 THEN -1 ELSE 1 END AS p FROM t), v AS (SELECT DISTINCT id, (id * 7 % 10) / 10 AS tau FROM (SELECT source AS id FROM t UNION ALL SELECT target FROM t))"


def dag(spark, d):
    return trade(spark, d).filter("source < target")


def signed(spark, d):
    t = cut(trade(spark, d))
    most = t.agg(F.max("weight").alias("_m"))
    edges = t.join(F.broadcast(most), F.lit(True)).select("source", "target", (F.col("weight") / F.col("_m")).alias("weight"), F.when((F.col("source") + F.col("target")) % 3 == 0, -1).otherwise(1).alias("polarity"))
    return G.ends(t).withColumn("tau", F.col("node_id") * 7 % 10 / 10), edges


def _pagerank_sql(rounds):
    sql = T + NODES + ", s AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM t), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, 1.0::DOUBLE / n AS x FROM v, n)"
    for k in range(rounds):
        sql += (
            f", r{k + 1} AS MATERIALIZED (SELECT v.id AS id, 0.15 / n + 0.85 * (coalesce((SELECT sum(x * share) FROM r{k} JOIN s ON s.source = r{k}.id WHERE s.target = v.id), 0)"
            f" + (SELECT coalesce(sum(x), 0) FROM r{k} WHERE id NOT IN (SELECT source FROM t)) / n) AS x FROM v, n)"
        )
    return sql + f" SELECT id AS node_id, round(x, 6) AS score FROM r{rounds}"


@query("gra01_pagerank", _pagerank_sql(12))
def _(spark, d):
    return G.pagerank(trade(spark, d), rounds=12, tolerance=None).select("node_id", F.round("score", 6).alias("score"))


@query("gra02_pagerank_converged")
def _(spark, d):
    return G.pagerank(trade(spark, d)).select("node_id", F.round("score", 6).alias("score"))


@query(
    "gra03_betweenness",
    T + NODES + ", e AS (SELECT DISTINCT source, target FROM t), "
    "walk AS (SELECT id AS s, id AS v, 0 AS d FROM v UNION SELECT s, target, d + 1 FROM walk JOIN e ON source = walk.v WHERE d < 40), "
    "far AS MATERIALIZED (SELECT s, v, min(d) AS d FROM walk GROUP BY 1, 2), "
    "dist AS (SELECT id AS s, id AS v, 0 AS d, 1.0::DOUBLE AS c FROM v UNION ALL SELECT dist.s, far.v, far.d, sum(dist.c) FROM dist JOIN e ON source = dist.v JOIN far ON far.s = dist.s AND far.v = target AND far.d = dist.d + 1 GROUP BY 1, 2, 3), "
    "x AS (SELECT a.v AS node_id, sum(a.c * b.c / w.c) AS score FROM dist a JOIN dist b ON a.v = b.s JOIN dist w ON w.s = a.s AND w.v = b.v AND w.d = a.d + b.d WHERE a.s <> a.v AND b.s <> b.v AND a.s <> b.v GROUP BY 1) "
    "SELECT id AS node_id, round(coalesce(score, 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2), 6) AS score FROM v LEFT JOIN x ON id = node_id",
)
def _(spark, d):
    return G.betweenness(trade(spark, d)).select("node_id", F.round("score", 6).alias("score"))


def _eigen_sql(rounds):
    sql = T + NODES + ", u AS (SELECT source, target, weight / 1e6 AS weight FROM t), x0 AS (SELECT id, 1.0::DOUBLE AS x FROM v)"
    for k in range(rounds):
        sql += f", y{k} AS MATERIALIZED (SELECT v.id AS id, x{k}.x + coalesce((SELECT sum(z.x * weight) FROM u JOIN x{k} z ON z.id = source WHERE target = v.id), 0) AS x FROM v JOIN x{k} ON x{k}.id = v.id), x{k + 1} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{k}) AS x FROM y{k})"
    return sql + f" SELECT id AS node_id, round(x, 5) AS score FROM x{rounds}"


@query("gra04_eigenvector", _eigen_sql(12))
def _(spark, d):
    return G.eigenvector(trade(spark, d).withColumn("weight", F.col("weight") / 1e6), rounds=12).select("node_id", F.round("score", 5).alias("score"))


@query("gra05_components", T2 + NODES + ", r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, CASE WHEN t.source = r.b THEN t.target ELSE t.source END FROM r JOIN t ON r.b IN (t.source, t.target)) SELECT a AS node_id, min(b) AS component FROM r GROUP BY a")
def _(spark, d):
    return G.components(trade(spark, d, 2))


@query("gra06_communities")
def _(spark, d):
    return C.communities(trade(spark, d, 2))


@query("gra07_leiden")
def _(spark, d):
    return C.communities(trade(spark, d, None), refine=True)


@query("gra08_hierarchy")
def _(spark, d):
    return C.hierarchy(trade(spark, d, 2), limit=30)


@query(
    "gra09_modularity",
    T + ", c AS (SELECT weight, source % 3 AS ca, target % 3 AS cb FROM t), m AS (SELECT sum(weight) AS m FROM t), g AS (SELECT k, coalesce((SELECT sum(weight) FROM c WHERE ca = k AND cb = k), 0) AS i, (SELECT sum(CASE WHEN ca = k THEN weight ELSE 0 END + CASE WHEN cb = k THEN weight ELSE 0 END) FROM c) AS g FROM (SELECT DISTINCT ca AS k FROM c UNION SELECT DISTINCT cb FROM c))"
    " SELECT k AS community, round(i / m - (g / (2 * m)) * (g / (2 * m)), 6) AS part FROM g, m",
)
def _(spark, d):
    t = trade(spark, d)
    return G.modularity(t, G.ends(t).withColumn("community", F.col("node_id") % 3)).select("community", F.round("part", 6).alias("part"))


_HOPS = ", r(id, hop) AS (SELECT {seed}, 0 UNION SELECT t.target, hop + 1 FROM r JOIN t ON t.source = r.id WHERE hop < 5)"


@query("gra11_neighborhood", T + _HOPS.format(seed="7") + " SELECT id AS node_id, min(hop) AS hop FROM r WHERE hop <= 2 GROUP BY id")
def _(spark, d):
    return G.hops(trade(spark, d), spark.createDataFrame([(7,)], "node_id int"), 2)


@query("gra12_expansion", T2 + ", b AS (SELECT source, target FROM t UNION SELECT target, source FROM t), r(id, hop) AS (SELECT 3, 0 UNION SELECT b.target, hop + 1 FROM r JOIN b ON b.source = r.id WHERE hop < 2) SELECT source, target FROM t WHERE source IN (SELECT id FROM r) AND target IN (SELECT id FROM r)")
def _(spark, d):
    return G.expand(trade(spark, d, 2), spark.createDataFrame([(3,)], "node_id int"), 2).select("source", "target")


@query("gra13_upstream", T + ", r(id, hop) AS (SELECT 12, 0 UNION SELECT t.source, hop + 1 FROM r JOIN t ON t.target = r.id WHERE hop < 6) SELECT id AS node_id, min(hop) AS hop FROM r GROUP BY id")
def _(spark, d):
    return G.hops(G.reversed_edges(trade(spark, d)), spark.createDataFrame([(12,)], "node_id int"), 6)


_CLOSED = DAG + ", r AS (SELECT source, target FROM d UNION SELECT r.source, d.target FROM r JOIN d ON r.target = d.source)"


@query("gra15_closure", T + _CLOSED + " SELECT source, target FROM r")
def _(spark, d):
    return G.closure(dag(spark, d))


@query("gra16_reduction", T + _CLOSED + " SELECT source, target FROM d WHERE NOT EXISTS (SELECT 1 FROM d x JOIN r ON r.source = x.target WHERE x.source = d.source AND r.target = d.target)")
def _(spark, d):
    return R.reduction(dag(spark, d))


@query("gra17_strong_components", T + NODES + ", r AS (SELECT source, target FROM t UNION SELECT r.source, t.target FROM r JOIN t ON r.target = t.source) SELECT id AS node_id, coalesce((SELECT min(x.target) FROM r x JOIN r y ON y.source = x.target AND y.target = x.source WHERE x.source = id AND x.target < id), id) AS component FROM v")
def _(spark, d):
    return R.strong_components(trade(spark, d))


@query("gra17_cycles", T + ", r AS (SELECT source, target FROM t UNION SELECT r.source, t.target FROM r JOIN t ON r.target = t.source) SELECT source AS node_id FROM r WHERE source = target")
def _(spark, d):
    return R.on_cycles(trade(spark, d))


@query("gra18_roots", T + DAG + " SELECT DISTINCT source AS node_id FROM d WHERE source NOT IN (SELECT target FROM d)")
def _(spark, d):
    return G.roots(dag(spark, d))


_LEVELS = DAG + ", r(id, k) AS (SELECT DISTINCT source, 0 FROM d WHERE source NOT IN (SELECT target FROM d) UNION SELECT d.target, k + 1 FROM r JOIN d ON d.source = r.id)"


@query("gra19_levels", T + _LEVELS + " SELECT id AS node_id, max(k) AS level FROM r GROUP BY id")
def _(spark, d):
    return G.levels(dag(spark, d))


@query("gra20_stale", T + _CLOSED + " SELECT DISTINCT id AS node_id FROM (SELECT source AS id FROM d WHERE source % 5 = 0 UNION ALL SELECT target FROM r WHERE source % 5 = 0)")
def _(spark, d):
    e = cut(dag(spark, d))
    changed = e.filter("source % 5 = 0").select(F.col("source").alias("node_id"))
    return G.hops(e, changed).select("node_id")


@query("gra24_empirical_content", T + ", z AS (SELECT source, target FROM t WHERE source % 4 <> 0), r AS (SELECT source AS a FROM z WHERE target % 4 = 0 UNION SELECT z.source FROM z JOIN r ON z.target = r.a) SELECT round((SELECT count(*) FROM r) / (SELECT count(DISTINCT id) FROM (SELECT source AS id FROM t UNION ALL SELECT target FROM t) WHERE id % 4 <> 0), 6) AS empirical_content")
def _(spark, d):
    t = cut(trade(spark, d))
    theory = G.ends(t).filter("node_id % 4 <> 0")
    grounded = G.hops(G.reversed_edges(t.filter("source % 4 <> 0")), t.filter("source % 4 <> 0 AND target % 4 = 0").select(F.col("source").alias("node_id")))
    both = theory.join(grounded.withColumn("g", F.lit(1)), "node_id", "left")
    return both.agg(F.round(F.count("g") / F.count("*"), 6).alias("empirical_content"))


_UPDATE = {
    "linear": "least(1, greatest(0, tau + s - q))",
    "categorizer": "least(1, greatest(0, tau / greatest(1 + q, 1e-9) * (1 + s / (1 + s))))",
    "euler": "least(1, greatest(0, 1 - (1 - tau * tau) / greatest(1 + tau * exp(least(50, greatest(-50, s - q))), 1e-9)))",
    "quadratic": "least(1, greatest(0, tau + (1 - tau) * s / (1 + s) - tau * q / (1 + q)))",
    "overlay": "CASE WHEN s - q >= 0 THEN tau + (1 - tau) * (s - q) / (1 + s - q) ELSE tau / (1 + abs(s - q)) END",
}


def _qbaf_sql(kind, rounds, edges="a", prefix="k", tail=None):
    sql = (T + SIGNED if tail is None else "") + f", {prefix}0 AS (SELECT id, tau, tau AS x, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q FROM v)"
    for k in range(rounds):
        flow = lambda sign, k=k: f"coalesce((SELECT sum(z.x * w) FROM {edges} JOIN {prefix}{k} z ON z.id = source WHERE target = v.id AND p = {sign}), 0)"
        sql += f", {prefix}{k + 1} AS MATERIALIZED (SELECT id, tau, {_UPDATE[kind]} AS x, s, q FROM (SELECT id, tau, {flow(1)} AS s, {flow(-1)} AS q FROM v))"
    return sql if tail is not None else sql + f" SELECT id AS node_id, round(x, 5) AS strength, round(s, 4) AS support, round(q, 4) AS attack FROM {prefix}{rounds}"


def _register(number, kind):
    @query(f"qbf{number}_{kind}", _qbaf_sql(kind, 8))
    def _(spark, d):
        return Q.solve(*signed(spark, d), kind, 8, None).select("node_id", F.round("strength", 5).alias("strength"), F.round("support", 4).alias("support"), F.round("attack", 4).alias("attack"))


for _number, _kind in (("04", "quadratic"), ("05", "euler"), ("06", "categorizer"), ("07", "linear"), ("12", "overlay")):
    _register(_number, _kind)


@query("qbf03_converged")
def _(spark, d):
    return Q.solve(*signed(spark, d)).select("node_id", F.round("strength", 4).alias("strength"), F.round("volatility", 4).alias("volatility"))


@query(
    "qbf11_mode_comparison",
    T + SIGNED + ", h AS (SELECT * FROM a WHERE w >= 0.6)" + _qbaf_sql("quadratic", 6, "a", "f", "") + _qbaf_sql("quadratic", 6, "h", "g", "") + " SELECT f6.id AS node_id, round(g6.x - f6.x, 5) AS drift FROM f6 JOIN g6 ON f6.id = g6.id",
)
def _(spark, d):
    nodes, edges = signed(spark, d)
    full = Q.solve(nodes, edges, "quadratic", 6, None)
    hard = Q.solve(nodes, Q.gated(edges, 0.6), "quadratic", 6, None)
    return Q.compare(full, hard).select("node_id", F.round("drift", 5).alias("drift"))


@query("qbf13_contributions")
def _(spark, d):
    nodes, edges = signed(spark, d)
    target = edges.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").first()["target"]
    return Q.ablate(nodes, edges, target).select("node_id", F.round("contribution", 5).alias("contribution"))


@query("qbf09_acyclic")
def _(spark, d):
    nodes, edges = signed(spark, d)
    return Q.solve_acyclic(nodes, edges.filter("source < target")).select("node_id", F.round("strength", 5).alias("strength"))


def _still_sql(rounds):
    """Fixed-point rounds, which on this graph lead to the same equilibrium as the continuous dynamics."""
    sql = T + SIGNED + ", k0 AS (SELECT id, tau, tau AS x FROM v)"
    h = lambda e: f"(power(greatest({e}, 0), 2) / (1 + power(greatest({e}, 0), 2)))"
    for k in range(rounds):
        sql += f", k{k + 1} AS MATERIALIZED (SELECT id, tau, tau + (1 - tau) * {h('e')} - tau * {h('-e')} AS x FROM (SELECT v.id AS id, any_value(v.tau) AS tau, coalesce(sum(z.x * w * p), 0) AS e FROM v LEFT JOIN a ON target = v.id LEFT JOIN k{k} z ON z.id = source GROUP BY v.id))"
    return sql + f" SELECT id AS node_id, round(x, 3) AS strength FROM k{rounds}"


@query("qbf10_cyclic", _still_sql(40))
def _(spark, d):
    return Q.solve_cyclic(*signed(spark, d), rtol=1e-3, atol=1e-5, still=1e-6).select("node_id", F.round("strength", 3).alias("strength"))
