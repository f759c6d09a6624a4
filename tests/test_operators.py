"""Operators on small hand-worked graphs and tables: conventions, nulls, ties and empty input."""

import pytest
from pyspark.sql import functions as F

from argloom.operators import evaluation as V
from argloom.operators import graph as G
from argloom.operators import qbaf as Q
from argloom.operators import relational as R
from argloom.operators import retrieval as S

EDGE = "source string, target string, weight double, polarity int"


def arg(spark, taus, edges):
    nodes = spark.createDataFrame(list(taus.items()), "node_id string, tau double")
    return nodes, spark.createDataFrame(edges, EDGE)


def strengths(frame):
    return {r.node_id: r.strength for r in frame.collect()}


def test_support_and_attack(spark):
    s = strengths(Q.solve(*arg(spark, {"claim": 0.5, "sup": 0.8, "att": 0.7}, [("sup", "claim", 0.9, 1), ("att", "claim", 0.6, -1)])))
    assert s["claim"] > 0.5 and s["sup"] == 0.8


@pytest.mark.parametrize("kind", ["euler", "categorizer", "linear", "quadratic", "overlay"])
def test_support_raises(spark, kind):
    assert strengths(Q.solve(*arg(spark, {"a": 0.6, "b": 0.9}, [("b", "a", 0.8, 1)]), kind))["a"] > 0.6


def test_mutual_attack(spark):
    s = strengths(Q.solve(*arg(spark, {"a": 0.7, "b": 0.7}, [("a", "b", 0.8, -1), ("b", "a", 0.8, -1)])))
    assert abs(s["a"] - s["b"]) < 1e-9 and s["a"] < 0.7


def test_balance_and_hub(spark):
    x = [r for r in Q.solve(*arg(spark, {"x": 0.5, "s": 0.8, "a": 0.8}, [("s", "x", 0.8, 1), ("a", "x", 0.8, -1)])).collect() if r.node_id == "x"][0]
    assert abs(x.strength - 0.5) < 1e-9 and x.evidence > 1 and x.volatility > 0.5
    many = {"hub": 0.8, **{f"n{i}": 0.8 for i in range(100)}}
    assert 0 <= strengths(Q.solve(*arg(spark, many, [(f"n{i}", "hub", 0.8, -1) for i in range(100)])))["hub"] < 0.05


def test_acyclic_equilibrium(spark):
    edges = [("0", "2", 0.8, 1), ("1", "2", 0.4, -1), ("1", "3", 0.7, 1), ("2", "4", 0.9, 1), ("3", "4", 0.6, 1)]
    s = strengths(Q.solve_acyclic(*arg(spark, dict(zip("01234", (0.9, 0.7, 0.5, 0.6, 0.5), strict=True)), edges)))
    h = lambda e: max(e, 0) ** 2 / (1 + max(e, 0) ** 2)
    two = 0.5 + 0.5 * h(0.9 * 0.8 - 0.7 * 0.4)
    three = 0.6 + 0.4 * h(0.49)
    assert abs(s["2"] - two) < 1e-9 and abs(s["4"] - (0.5 + 0.5 * h(two * 0.9 + three * 0.6))) < 1e-9


def test_gates(spark):
    e = spark.createDataFrame([("a", "b", 0.4, None), ("a", "c", None, 0.9), ("a", "d", 0.9, 0.1)], "source string, target string, weight double, confidence double")
    assert {r.target: r.pruned for r in R.gate(e, 0.7, 0.5).collect()} == {"b": True, "c": False, "d": True}
    assert Q.gated(e, 0.7).count() == 2


def test_components_and_closure(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "f")]
    e = spark.createDataFrame(pairs, "source string, target string")
    assert {r.node_id: r.component for r in G.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}
    assert {r.node_id for r in G.on_cycles(e).collect()} == {"a", "b", "c", "f"}
    assert G.closure(e.limit(0)).collect() == [] and G.components(e.limit(0)).collect() == []
    with pytest.raises(ValueError, match="cycle"):
        G.levels(e)


def test_dag_operators(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "source int, target int")
    assert {(r.source, r.target) for r in G.reduction(e).collect()} == {(1, 2), (2, 3), (3, 4)}
    assert {r.node_id: r.level for r in G.levels(e).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert [r.node_id for r in G.roots(e).collect()] == [1]
    assert {r.node_id: r.hop for r in G.hops(e, spark.createDataFrame([(1,)], "node_id int")).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_centrality(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "source string, target string, weight double")
    between = {r.node_id: r.score for r in G.betweenness(e, normalized=False).collect()}
    assert between == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    rank = {r.node_id: r.score for r in G.pagerank(e).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank["d"] > rank["a"]


def test_communities_cover_and_score(spark):
    clique = [(a, b, 1.0) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 0.1)]
    e = spark.createDataFrame(clique, "source int, target int, weight double")
    found = G.label_communities(e)
    assert found.count() == 10 and found.select("community").distinct().count() == 2
    single = G.ends(e).withColumn("community", F.col("node_id"))
    total = lambda p: G.modularity(e, p).agg(F.sum("part")).first()[0]
    assert total(found) > total(single)


def test_calibration(spark):
    pairs = spark.createDataFrame([(0.9, 1), (0.9, 1), (0.1, 0), (0.1, 0)], "confidence double, label int")
    got = V.calibration(pairs, 10).first()
    assert (round(got.ece, 6), round(got.mce, 6), round(got.brier, 6)) == (0.1, 0.1, 0.01)
    wrong = V.calibration(spark.createDataFrame([(1.0, 0)] * 3, "confidence double, label int")).first()
    assert (wrong.ece, wrong.mce, wrong.brier) == (1.0, 1.0, 1.0)
    none = V.calibration(pairs.limit(0)).first()
    assert (none.ece, none.mce, none.brier) == (0.0, 0.0, 0.0)


def test_rank_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "query_id int, doc_id string")
    got = {r.query_id: r for r in S.rank_metrics(ranking, gold).collect()}
    assert (got[1].mrr, got[1].ndcg, got[1].ap) == (1.0, 1.0, 1.0) and got[2].mrr == 0.5 and got[3].mrr == 0.0


def test_dynamics(spark):
    rows = [(1, "core", 1), (1, "auxiliary", 2), (2, "core", 1), (2, "auxiliary", 2), (2, "auxiliary", 3)] + [(2, "empirical", i) for i in range(5)]
    snap = spark.createDataFrame(rows, "epoch long, kind string, item long")
    step = V.degeneration(snap).first()
    assert (step.new_auxiliary, step.new_empirical, step.anomalies) == (1, 5, 0) and abs(step.di - 0.2) < 1e-3
    assert V.dropped_core(snap).count() == 0
    assert V.dropped_core(spark.createDataFrame([(1, "core", 1), (2, "auxiliary", 1)], snap.schema)).count() == 1


def test_prf_conventions(spark):
    a = spark.createDataFrame([(1,)], "k int")
    none = a.limit(0)
    assert R.prf(none, none, ["k"]).first()["f1"] == 1.0
    one = R.prf(a, none, ["k"]).first()
    assert (one["precision"], one["recall"]) == (0.0, 0.0)


def test_greedy_matching(spark):
    scores = spark.createDataFrame([("r1", "p1", 0.9), ("r1", "p2", 0.9), ("r2", "p1", 0.8), ("r2", "p2", 0.7), ("r3", "p9", 0.2)], "ref string, pred string, score double")
    assert {(r.ref, r.pred) for r in V.greedy_matching(scores).collect()} == {("r1", "p1"), ("r2", "p2")}


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, created string, v double")
    new = spark.createDataFrame([(2, "z", 9.0), (3, "w", None)], "k int, created string, v double")
    assert {tuple(r) for r in R.upsert(old, new, "k", ["created"]).collect()} == {(1, "x", 1.0), (2, "y", 9.0), (3, "w", None)}
