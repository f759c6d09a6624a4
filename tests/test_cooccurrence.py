"""Pairs that share groups are counted where they are made."""

import random
from collections import Counter
from itertools import combinations

import pytest

from argloom.operators import cooccurrence as O
from argloom.registry import QUERIES


def pairs_of(rows):
    groups = {}
    for a, p in set(rows):
        if a is not None and p is not None:
            groups.setdefault(p, []).append(a)
    return Counter(pair for g in groups.values() for pair in combinations(sorted(g), 2))


@pytest.mark.parametrize("block", [1 << 23, 40])
def test_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK_PAIRS", block)
    r = random.Random(4)
    rows = [(r.randrange(60) ** 3 - 9, r.randrange(30)) for _ in range(400)] + [(10**15 + i, 7) for i in range(40)] + [(5, None), (None, 7), (-9, 7), (-9, 7)]
    got = O.shared_groups(spark.createDataFrame(rows, "a bigint, p bigint")).collect()
    assert {(x.a, x.b): x.n_shared for x in got} == pairs_of(rows) and len(got) == len(pairs_of(rows))
    assert O.shared_groups(spark.createDataFrame([], "a bigint, p bigint")).count() == 0


def test_a_member_of_many_groups_is_counted_over_turns(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(O, "MADE", 3)
    monkeypatch.setattr(O, "SENT", 2)
    r = random.Random(9)
    rows = [(a, p, int(a >= 4)) for p in range(12) for a in r.sample(range(8), 5)]
    lists = list(O._sent(iter([pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in ((1, pa.int64()), (0, pa.int64()), (2, pa.int32()))], names=["p", "a", "block"])])))
    got = []
    for block in (0, 1):
        own = [b.filter(pa.array([x == block for x in b.column(0).to_pylist()])) for b in lists]
        got += [tuple(x.values()) for b in O._made(iter(own)) for x in b.to_pylist()]
    assert {(a, b): n for a, b, n in got} == pairs_of([x[:2] for x in rows]) and len(got) == len(set(x[:2] for x in got))


def test_shared_chunk_pairs_shuffle_members_and_no_pairs(spark):
    plan = QUERIES["joi09_shared_chunk_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 2
