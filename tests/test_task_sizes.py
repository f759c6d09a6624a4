"""Large tables are dealt to tasks of bounded size, and the results stay the same."""

from collections import Counter

import pytest

from argloom.operators import iterate
from argloom.operators import records as P
from argloom.operators import relational as R
from argloom.plans import relational_queries
from argloom.plans.bindings import edges
from argloom.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(iterate.dealt, "__kwdefaults__", {"most": 100})


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_join_in_tasks_of_bounded_size(spark, small_tasks):
    e = edges(spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert plan(e).count("RepartitionByExpression [l_orderkey") == 1 and f", {-(-rows // 100)}" in plan(e)
    assert e.count() == rows


def test_degrees_read_the_edges_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "b"), (None, "a")], "source string, target string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert plan(R.degrees(n, e)).count("Union") == 0
    assert {r.node_id: r.degree for r in R.degrees(n, e).collect()} == {"a": 2, "b": 3, "c": 0}


def test_a_later_batch_does_not_join_earlier_ones_again(spark):
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "item int")
    triples, after = P.commit_batch(rows([1]), rows([1, 2, 2]), rows([1]), "item")
    triples, after = P.commit_batch(triples, rows([1, 2, 2]), after, "item")
    assert plan(after).count("Join") == 0
    assert Counter(r.item for r in triples.collect()) == {1: 1, 2: 2} and sorted(r.item for r in after.collect()) == [1, 2]


def test_lineages_and_pairs_are_dealt_to_bounded_tasks(spark, small_tasks, monkeypatch):
    monkeypatch.setattr(relational_queries, "TASK_ROWS", 100)
    for name, key in (("win09_lineage_dedupe", "ancestor"), ("joi09_shared_chunk_pairs", "p"), ("joi02_endpoint_texts", "source")):
        assert f"RepartitionByExpression [{key}#" in plan(QUERIES[name](spark, SF)), name
