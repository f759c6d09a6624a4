"""Theory-graph and record operators on small tables of their own."""

import pytest
from pyspark.sql import functions as F

from argloom.operators import records as P
from argloom.operators import relational as R
from argloom.operators import theory as H


def test_edge_weight_takes_the_first_rule_that_applies(spark):
    names = ("effective", "active", "inferential", "modal", "stance", "weight")
    rows = [(0.9, 0.7, 0.5, 0.4, 0.3, 0.2), (None, 0.7, 0.5, 0.4, 0.3, 0.2), (None, None, 0.5, 0.4, 0.3, 0.2), (None, None, None, 0.4, 0.3, 0.2), (None, None, 0.5, 0.4, None, 0.2), (None, None, None, None, None, -2.0), (None,) * 6]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = df.select(*(F.round(H.edge_weight({n: F.col(n) for n in names}, typed), 6) for typed in (True, False))).collect()
    assert [tuple(r) for r in got] == [(0.9, 0.7), (0.7, 0.7), (0.15, 0.15), (0.12, 0.12), (0.5, 0.5), (0.0, 0.0), (1.0, 1.0)]


def test_admission(spark):
    df = spark.createDataFrame([("a", 0.8, None, 0.1, None), ("b", 0.8, 0.9, 0.9, 0.9), ("c", 0.8, None, None, None)], "k string, weight double, accuracy double, stance double, confidence double")
    weights = lambda x: {r.k: round(r.weight, 3) for r in x.collect()}
    assert weights(H.admitted(df, stance=0.5)) == {"b": 0.8, "c": 0.8}
    assert weights(H.admitted(df, stance=0.5, prune=False, binary=True)) == {"a": 0.0, "b": 1.0, "c": 1.0}
    soft = weights(H.admitted(df, stance=0.5, soft=True))
    assert soft["a"] < 0.001 and soft["b"] == pytest.approx(0.8, abs=1e-3) and soft["c"] == 0.8


def test_similarity_of_nodes_and_anchors(spark):
    parts = {c: F.lit(x) for c, x in (("axiom", 0.5), ("name", 0.2), ("anchor", 0.4), ("type", 1.0), ("status", 0.5))}
    blend = lambda axiom, anchor, same: H.node_similarity(parts, F.lit(axiom), F.lit(anchor), F.lit(same))
    none, zero = F.lit(None).cast("double"), F.lit(False)
    row = spark.range(1).select(
        blend(True, True, False), blend(True, False, False), blend(False, True, False), blend(False, False, False), blend(False, False, True),
        H.anchor_similarity(none, none, F.lit(0.3), none, F.lit(0.9), none, zero, zero, zero), H.anchor_similarity(none, none, none, none, F.lit(0.9), none, F.lit(True), zero, zero),
        H.anchor_similarity(none, none, none, none, none, none, zero, F.lit(True), zero), H.name_similarity(F.lit("A b"), F.lit("b C"), zero), H.name_similarity(F.lit(" "), F.lit("x"), F.lit(True)),
    ).first()
    assert [round(x, 4) for x in row] == [0.455, 0.5, 0.435, 0.5, 0.85, 0.3, 0.0, 1.0, 0.3333, 1.0]


def test_lineage_ends_at_cycles_and_missing_parents(spark):
    rows = [(1, None), *((i, i - 1) for i in range(2, 12)), (20, 21), (21, 20), (30, 99)]
    got = {}
    for r in P.lineage(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect():
        got.setdefault(r.id, {})[r.ancestor] = r.depth
    assert got[11] == {a: 11 - a for a in range(1, 12)} and got[20] == {20: 0, 21: 1} and got[30] == {30: 0}


def test_writes(spark):
    cur = spark.createDataFrame([("a", "b", "r", 1), ("a", "c", "r", 1)], "source string, target string, relation string, w int")
    new = spark.createDataFrame([("a", "b", "r", 2), ("a", "x", "r", 2), ("b", "c", "r", 2)], cur.schema)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert sorted(map(tuple, P.upsert_relations(cur, new, ids).collect())) == [("a", "b", "r", 2), ("a", "c", "r", 1), ("b", "c", "r", 2)]
    props = spark.range(1).select(P.serialized({"a": F.lit(1), "b": F.lit(None).cast("string")}, {"c": F.array(F.lit(1), F.lit(2))})).first()[0]
    assert props == {"a": "1", "c": "[1,2]"}
    df = spark.createDataFrame([(list("abcab"),), (list("aabbccddee"),)], "x array<string>")
    assert [r[0] for r in df.select(P.bounded_distinct(F.col("x"), 3)).collect()] == [["a", "b", "c"], ["c", "d", "e"]]


def test_ranked_over_ranges(spark):
    df = spark.createDataFrame([(i, i % 17) for i in range(200)], "k int, v int").repartition(3)
    values = [i % 17 for i in range(200)]
    assert {(r.v, r.place) for r in R.ranked(df, "v", 5).collect()} == {(v, 1 + sum(x > v for x in values)) for v in values}
