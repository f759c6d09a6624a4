"""Communities of all relations, and passes over stored neighbours."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from argloom.operators import communities as C
from argloom.operators import sweeps
from argloom.plans import graph_queries
from argloom.plans.bindings import TRADE_SQL
from argloom.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_leiden_takes_all_relations(spark, monkeypatch):
    con, seen = duckdb.connect(), []
    for t in "supplier orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    flow = TRADE_SQL[: TRADE_SQL.index("),\nt AS") + 1]
    want = con.sql(f"WITH {flow} SELECT source, target FROM flow").fetchall()
    monkeypatch.setattr(graph_queries.C, "communities", lambda e, run=C.communities, **k: seen.append(e) or run(e, **k))
    found = QUERIES["gra07_leiden"](spark, SF).collect()
    assert len(want) > 2 * len({s for s, _ in want})
    assert sorted((r.source, r.target) for r in seen[0].collect()) == sorted(want)
    assert {r.node_id for r in found} == {x for e in want for x in e}


def planted(groups, size, seed=1):
    """Cliques of ``size`` with light edges between all other nodes."""
    r = random.Random(seed)
    return [(a, b, 1.0 + r.random() if a % groups == b % groups else 0.02) for a, b in combinations(range(groups * size), 2)]


@pytest.mark.parametrize("block", [0, C.BLOCK])
def test_passes_and_arrays_find_planted_groups(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "DENSE", block)
    monkeypatch.setattr(C, "NEIGHBOURS", 4)
    df = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", w) for a, b, w in planted(3, 12)], "source string, target string, weight double")
    found = {r.node_id: r.community for r in C.communities(df, refine=True).collect()}
    assert found == {f"n{i:03}": f"n{i % 3:03}" for i in range(36)}


def test_stored_rows_hold_whole_nodes(monkeypatch):
    monkeypatch.setattr(sweeps, "ENTRIES", 5)
    rows = [(v, o, float(o)) for v in range(8) for o in range(1 + 3 * (v % 4))]
    given = random.Random(2).sample(rows, len(rows))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in given[at : at + 4]], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["node", "other", "w"]) for at in range(0, len(rows), 4)]
    got, nodes = [], []
    for b in sweeps._packed(iter(batches)):
        node, counts, other = (np.frombuffer(b.column(i)[0].as_py(), "<i4") for i in (1, 2, 3))
        w = np.frombuffer(b.column(4)[0].as_py(), "<f8")
        assert set(sweeps._class_of(node)) == {b.column(0)[0].as_py()} and (counts.sum() <= 5 or len(node) == 1)
        nodes += node.tolist()
        got += zip(np.repeat(node, counts).tolist(), other.tolist(), w.tolist(), strict=True)
    assert sorted(got) == rows and sorted(nodes) == list(range(8))
