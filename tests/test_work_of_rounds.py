"""What loops read and write: given tables are evaluated once, and what a round stores is no square of the nodes."""

import random

import pytest

from argloom.operators import graph as G
from argloom.operators import qbaf as Q
from argloom.operators import reachability as V


def counted(spark, df):
    """``df``, and a counter of its rows each time that it is evaluated."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


CHAIN = [(i, i + 1) for i in range(8)]


def test_levels_evaluate_their_edges_once(spark):
    edges, seen = counted(spark, spark.createDataFrame(CHAIN, "source int, target int"))
    assert {tuple(r) for r in G.levels(edges).collect()} == {(i, i) for i in range(9)}
    assert seen.value == len(CHAIN)


def test_hops_evaluate_their_edges_once(spark):
    edges, seen = counted(spark, spark.createDataFrame(CHAIN, "source int, target int"))
    assert {tuple(r) for r in G.hops(edges, spark.createDataFrame([(3,)], "node_id int")).collect()} == {(i, i - 3) for i in range(3, 9)}
    assert seen.value == len(CHAIN)


def test_ablation_stores_no_square_of_the_nodes(spark, monkeypatch):
    r, n, rows = random.Random(3), 300, []
    keep = Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: (lambda made: (rows.append(made.count()), made)[1])(keep(df)))
    tau = {i: r.random() for i in range(n)}
    edges = [(i, i + 1, r.random(), r.choice([1, -1])) for i in range(n - 1)] + [(5, 290, 0.5, 1)]
    got = {x.node_id: x.contribution for x in Q.ablate(spark.createDataFrame(list(tau.items()), "node_id int, tau double"), spark.createDataFrame(edges, "source int, target int, weight double, polarity int"), 299, rounds=10).collect()}
    assert max(rows) < 10 * n

    def solved(gone):
        now = dict(tau)
        for _ in range(10):
            flow = {(v, p): sum(now[a] * w for a, b, w, q in edges if b == v and q == p and gone not in (a, b)) for v in tau for p in (1, -1)}
            now = {v: t + (1 - t) * flow[v, 1] / (1 + flow[v, 1]) - t * flow[v, -1] / (1 + flow[v, -1]) for v, t in tau.items()}
        return now[299]

    base = solved(None)
    assert set(got) == set(range(299))
    assert all(got[g] == pytest.approx(base - solved(g), abs=1e-12) for g in [0, 4, 5, 6, 150, *range(286, 299)])
    assert got[150] == 0 and got[298] != 0


def test_common_reach_takes_rounds_by_depth_and_not_by_targets(spark, monkeypatch):
    r, cuts = random.Random(5), []
    keep = V.cut
    monkeypatch.setattr(V, "WORDS", 1)
    monkeypatch.setattr(V, "cut", lambda df: (cuts.append(1), keep(df))[1])
    edges = sorted({(a, a + r.randint(50, 200)) for a in range(700) for _ in range(2)})
    few = [e for e in edges if sum(e) % 4]

    def closure(pairs):
        out = set(pairs)
        while longer := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
            out |= longer
        return out

    one, two = closure(few), closure(edges)
    df = lambda rows: spark.createDataFrame(rows, "source int, target int")
    assert tuple(V.common_reach(df(few), df(edges)).first()) == (len(one), len(two), len(one & two))
    assert len(cuts) < 25  # 13 batches of 64 targets, paths of up to 16 edges
    monkeypatch.setattr(V, "STATE", 6 * 2 * 900)  # some batches at a time
    assert tuple(V.common_reach(df(few), df(edges)).first()) == (len(one), len(two), len(one & two))


def test_leaves_of_many_levels_are_stored_only_where_a_round_ends(spark, monkeypatch):
    import json

    from pyspark.sql import functions as F

    from argloom.operators import records as P

    stored = []
    monkeypatch.setattr(P, "cut", lambda df, cut=P.cut: stored.append(cut(df)) or stored[-1])
    shallow = {"a": [{"b": [1, 2]}, {"b": []}]}
    deep = 7
    for i in range(3 * P.LEVELS):
        deep = {"k": deep} if i % 2 else [deep]
    rows = lambda xs: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(xs)], "id int, j string").select("id", F.parse_json("j").alias("v"))
    paths = lambda df: sorted((r.id, r.path.replace("[0]", "")) for r in df.collect())
    assert paths(P.leaf_fingerprints(rows([shallow]))) == [(0, "a.b"), (0, "a.b[1]"), (0, "a[1].b")]
    assert [df.count() for df in stored] == [1, 0]
    assert paths(P.leaf_fingerprints(rows([shallow, deep])))[-1] == (1, ".".join(["k"] * (3 * P.LEVELS // 2)))
    assert [df.count() for df in stored[2:]] == [2, 1, 1, 1, 0]


def test_embeddings_shuffle_a_row_per_text(spark):
    from argloom.functions.text import hash_embedding, sparse_embedding

    docs = spark.createDataFrame([(1, "The cat, the CAT and ünïcode_7"), (2, None), (3, " .,"), (4, "one two"), (4, "two three four"), (None, "no id"), (5, "")], "doc_id int, text string")
    rows = sparse_embedding(docs, "doc_id", "text")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    got = sorted(((r.id, slot, x) for r in rows.collect() for slot, x in zip(r.slots, r.xs, strict=True)), key=str)
    assert got == sorted(map(tuple, hash_embedding(docs, "doc_id", "text").collect()), key=str)
    # Opposite signs in one slot leave nothing, within a text and between texts of one id.
    from hashlib import md5

    word = {md5(f"w{i}".encode()).digest()[-1]: f"w{i}" for i in range(3000)}
    one = next(b for b in range(128) if b in word and b + 128 in word)
    rows = spark.createDataFrame([(1, f"{word[one]} {word[one + 128]}"), (2, word[one]), (2, word[one + 128])], "doc_id int, text string")
    assert sparse_embedding(rows, "doc_id", "text").count() == 0


def test_links_read_words_of_near_candidates_only(spark):
    from argloom.operators import retrieval as R

    texts = spark.createDataFrame([(i, f"shared word{i}") for i in range(20)], "candidate_id int, text string")
    mentions = spark.createDataFrame([(7, "shared word3"), (8, None)], "mention_id int, text string")
    links = R.linked(mentions, texts, 2, 0.25)
    assert "LeftSemi" in links._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.mention_id, r.candidate_id, r.outcome) for r in links.collect()} == {(7, 3, "linked"), (8, None, "novel")}


def test_diagnostics_search_phrases_once(spark, monkeypatch):
    from argloom.plans import evaluation_queries as E
    from argloom.registry import QUERIES

    read = []

    def found(docs, phrases, find=E.find_phrases):
        docs, seen = counted(spark, docs)
        read.append((docs.count(), seen.value, seen))
        return find(docs, phrases)

    monkeypatch.setattr(E, "find_phrases", found)
    assert QUERIES["ret06_diagnostics"](spark, "/root/testdata/sf0.001").count() > 0
    ((rows, before, seen),) = read
    assert rows > 0 and seen.value - before == rows


def test_solving_evaluates_edges_once_and_sends_few_sources(spark, monkeypatch):
    from argloom.operators.theory import with_missing_ends

    rows = [("s1", "c1", 0.4, 1), ("s2", "c1", 0.7, -1), ("s1", "c2", 0.2, -1), ("c2", "s2", 0.9, 1), ("x", "y", 0.5, 1), (None, "c1", 1.0, 1), ("s1", "s1", 0.3, 1)]
    given = spark.createDataFrame(rows, "source string, target string, weight double, polarity int")
    nodes = spark.createDataFrame([("s1", 0.6), ("s2", 0.8), ("c1", 0.3), ("c2", 0.5), ("z", 0.1)], "node_id string, tau double")
    strengths = lambda df: {r.node_id: round(r.strength, 9) for r in df.filter("node_id IS NOT NULL").collect()}
    edges, seen = counted(spark, given)
    plans = []
    monkeypatch.setattr(Q, "cut", lambda df, cut=Q.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = strengths(Q.solve(nodes, edges, rounds=2, tolerance=None, missing=0.5))
    assert seen.value == len(rows)
    assert sum("strategy=broadcast" in p for p in plans) == 2
    # By hand, with all nodes of the round before.
    now = tau = {"s1": 0.6, "s2": 0.8, "c1": 0.3, "c2": 0.5, "z": 0.1, "x": 0.5, "y": 0.5}
    for _ in range(2):
        total = lambda n, sign: sum(now[s] * w for s, t, w, p in rows if s and t == n and p == sign)
        now = {n: t + (1 - t) * total(n, 1) / (1 + total(n, 1)) - t * total(n, -1) / (1 + total(n, -1)) for n, t in tau.items()}
    assert got == {n: round(x, 9) for n, x in now.items()}
    plans.clear()
    monkeypatch.setattr(Q, "SENT_ROWS", 0)
    assert strengths(Q.solve(with_missing_ends(nodes, given), given, rounds=2, tolerance=None)) == got
    assert not any("strategy=broadcast" in p for p in plans)
