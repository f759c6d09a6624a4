"""Communities, reachability and continuous strengths against single-machine versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from argloom.operators import communities as C
from argloom.operators import graph as G
from argloom.operators import qbaf as Q
from argloom.operators import reachability as R
from argloom.plans.bindings import trade

SF = "/root/testdata/sf0.01"


def weights(edges):
    w = Counter()
    for a, b, x in edges:
        w[min(a, b), max(a, b)] += x
    return w


def quality(edges, part):
    w = weights(edges)
    m = sum(w.values())
    degree, inside = Counter(), 0.0
    for (a, b), x in w.items():
        degree[part[a]] += x
        degree[part[b]] += x
        inside += x if part[a] == part[b] else 0
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def louvain(edges, seed):
    """One machine: nodes in a seeded order, each to its best community, then folding."""
    rng, w = random.Random(seed), weights(edges)
    home = {x: x for e in w for x in e}
    while True:
        near, degree, m2 = defaultdict(Counter), Counter(), 2 * sum(w.values())
        for (a, b), x in w.items():
            degree[a] += x
            degree[b] += x
            if a != b:
                near[a][b] += x
                near[b][a] += x
        c, total = {x: x for x in degree}, Counter(degree)
        moved = True
        nodes = sorted(degree)
        any_moved = False
        while moved:
            moved = False
            rng.shuffle(nodes)
            for v in nodes:
                links = Counter({c[v]: 0.0})
                for u, x in near[v].items():
                    links[c[u]] += x
                total[c[v]] -= degree[v]
                best = max(sorted(links), key=lambda k: round(links[k] - degree[v] * total[k] / m2, 12))
                if links[best] - degree[v] * total[best] / m2 <= links[c[v]] - degree[v] * total[c[v]] / m2 + 1e-12:
                    best = c[v]
                total[best] += degree[v]
                if best != c[v]:
                    c[v], moved, any_moved = best, True, True
        home = {x: c[y] for x, y in home.items()}
        if not any_moved:
            return home
        folded = Counter()
        for (a, b), x in w.items():
            folded[min(c[a], c[b]), max(c[a], c[b])] += x
        w = folded


def connected(edges, members):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a in members and b in members:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [min(members)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    return seen == members


@pytest.fixture(scope="module")
def graph(spark):
    t = trade(spark, SF, 2).select("source", "target", F.col("weight").cast("double").alias("weight"))
    rows = [tuple(r) for r in t.collect()]
    return spark.createDataFrame(rows, "source int, target int, weight double"), rows


@pytest.mark.parametrize("refine", [True])
def test_communities_are_as_good_as_on_one_machine(spark, graph, refine):
    df, edges = graph
    found = {r.node_id: r.community for r in C.communities(df, refine=refine).collect()}
    assert set(found) == {x for a, b, _ in edges for x in (a, b)}
    groups = defaultdict(set)
    for node, c in found.items():
        groups[c].add(node)
    assert all(c == min(g) and connected(edges, g) for c, g in groups.items())
    assert quality(edges, found) >= quality(edges, louvain(edges, 1)) - 0.01


def test_two_cliques_loops_and_odd_edges(spark):
    clique = lambda xs: [(a, b, 1.0) for a in xs for b in xs if a < b]
    edges = [*clique("abcd"), *clique("wxyz"), ("d", "w", 0.5), ("a", "a", 1.0), ("q", "q", None), ("b", "a", None), (None, "a", 1.0)]
    df = spark.createDataFrame(edges, "source string, target string, weight double").withColumn("community", F.lit("clash"))
    for refine in (False, True):
        found = {r.node_id: r.community for r in C.communities(df, refine=refine).collect()}
        assert found == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w"), "q": "q"}
        df = df.repartition(3)  # the second algorithm reads other partitions
    assert C.communities(df.limit(0)).count() == 0


def test_hierarchy_bounds_nests_and_covers(spark):
    edges = [(i, i + 1, 1.0 + (i % 3 == 0)) for i in range(9)]
    df = spark.createDataFrame(edges, "source int, target int, weight double")
    limit, nodes = 3, set(range(10))
    rows = C.hierarchy(df, limit=limit).collect()
    final = [r for r in rows if r.final]
    assert Counter(r.node_id for r in final) == Counter(nodes)
    size = Counter((r.level, r.community) for r in rows)
    assert all(size[r.level, r.community] <= limit for r in final) and all(size[r.level, r.community] > limit for r in rows if not r.final)
    at = {(r.level, r.node_id): r for r in rows}
    assert all(r.parent is None if r.level == 0 else (r.parent == at[r.level - 1, r.node_id].community and not at[r.level - 1, r.node_id].final) for r in rows)
    assert max(r.level for r in rows) > 0


def test_small_parts_of_a_hierarchy_take_few_jobs(spark, graph):
    df, edges = graph
    spark.sparkContext.setJobGroup("few-jobs", "")
    rows = C.hierarchy(df, limit=8).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    levels = 1 + max(r.level for r in rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 30 * levels
    assert {r.node_id for r in rows if r.final} == {x for a, b, _ in edges for x in (a, b)}


def test_large_parts_go_by_rounds(spark, graph, monkeypatch):
    df, edges = graph
    monkeypatch.setattr(C, "BLOCK", len(edges) // 2)  # the folded graph goes on in a task
    found = {r.node_id: r.community for r in C.communities(df, refine=True).collect()}
    groups = defaultdict(set)
    for node, c in found.items():
        groups[c].add(node)
    assert set(found) == {x for a, b, _ in edges for x in (a, b)}
    assert all(c == min(g) and connected(edges, g) for c, g in groups.items())
    assert quality(edges, found) >= quality(edges, louvain(edges, 1)) - 0.01


def random_graph(seed, n, m, dag):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted((min(e), max(e)) if dag else e for e in edges if not dag or e[0] != e[1])


def closure(edges):
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_and_cycles(spark, seed):
    edges = [*random_graph(seed, 18, 22, False), (40, 40), (41, 42)]
    df = spark.createDataFrame(edges, "source int, target int")
    reach = closure(edges)
    nodes = {x for e in edges for x in e}
    want = {x: min([x, *(y for y in nodes if (x, y) in reach and (y, x) in reach)]) for x in nodes}
    assert {r.node_id: r.component for r in R.strong_components(df).collect()} == want
    assert {r.node_id for r in R.on_cycles(df).collect()} == {x for x in nodes if (x, x) in reach}
    assert {tuple(r) for r in R.condensed(df, R.strong_components(df)).collect()} == {(want[a], want[b]) for a, b in edges if want[a] != want[b]}


@pytest.mark.parametrize("seed", range(1))
def test_reachability_reduction_and_counts(spark, seed, monkeypatch):
    monkeypatch.setattr(R, "WORDS", 1)
    edges = random_graph(seed, 90, 150, True)
    df = spark.createDataFrame(edges, "source int, target int")
    reach = closure(edges)
    rng = random.Random(seed)
    asked = [(rng.randrange(90), rng.randrange(90)) for _ in range(200)]
    got = {tuple(r) for r in R.reaches(df, spark.createDataFrame(asked, "source int, target int")).collect()}
    assert got == set(asked) & reach
    kept = {e for e in edges if not any(e[0] == a and b != e[1] and (b, e[1]) in reach for a, b in edges)}
    assert {tuple(r) for r in R.reduction(df).collect()} == kept
    fewer = edges[::2] + [(5, 3)]
    n = R.common_reach(df, spark.createDataFrame(fewer, "source int, target int")).first()
    other = closure(fewer)
    assert tuple(n) == (len(reach), len(other), len(reach & other))


def test_reachability_of_empty_and_cyclic_graphs(spark):
    none = spark.createDataFrame([], "source int, target int")
    assert R.strong_components(none).count() == R.reduction(none).count() == R.on_cycles(none).count() == 0
    assert tuple(R.common_reach(none, none).first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        R.labels(spark.createDataFrame([(1, 2), (2, 1)], "source int, target int"))


def test_subsumption_by_edge(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d")], "source string, target string")
    models = spark.createDataFrame([("b", "actual", "m1"), ("b", "actual", "m1"), ("a", "potential", "p")], "node_id string, kind string, model string")
    axioms = spark.createDataFrame([("d",)], "node_id string")
    got = {(r.parent, r.child): (r.parent_actual, r.child_actual, r.specializing, r.subsumed) for r in R.subsumption(edges, models, axioms).collect()}
    assert got == {("a", "b"): (0, 1, True, True), ("a", "c"): (0, 0, False, False), ("b", "d"): (1, 0, True, True)}


def still(taus, edges):
    s = dict(taus)
    for _ in range(400):
        e = Counter()
        for a, b, w, p in edges:
            e[b] += w * p * s[a]
        h = lambda x: max(x, 0) ** 2 / (1 + max(x, 0) ** 2)
        s = {k: 0.5 * s[k] + 0.5 * (t + (1 - t) * h(e[k]) - t * h(-e[k])) for k, t in taus.items()}
    return s


def test_continuous_strengths_of_cycles(spark, monkeypatch):
    taus = {"a": 0.6, "b": 0.4, "c": 0.9, "d": 0.5, "lone": 0.3}
    edges = [("a", "b", 1.0, 1), ("b", "c", 0.8, -1), ("c", "a", 0.9, 1), ("d", "d", 0.5, -1), ("a", "d", 1.0, -1), ("a", "none", 1.0, 1)]
    nodes, e = spark.createDataFrame(list(taus.items()), "node_id string, tau double"), spark.createDataFrame(edges, "source string, target string, weight double, polarity int")
    want = still(taus, edges[:-1])
    for out in (1,):
        monkeypatch.setattr(Q, "_OUT", out)
        got = {r.node_id: (r.strength, r.residual) for r in Q.solve_cyclic(nodes, e, still=1e-5).collect()}
        assert set(got) == set(taus)
        assert all(abs(got[k][0] - want[k]) < 1e-4 and got[k][1] < 1e-5 for k in taus)
    fixed = {r.node_id: r.strength for r in Q.solve_cyclic(nodes, e, still=1e-3, t_max=0.0).collect()}
    assert all(abs(fixed[k] - want[k]) < 1e-2 for k in taus)


def test_continuous_strengths_of_a_dag_equal_the_closed_form(spark):
    taus = {i: (i * 7 % 10) / 10 for i in range(12)}
    edges = [(a, b, 0.3 + a / 20, 1 if (a + b) % 3 else -1) for a, b in random_graph(5, 12, 20, True)]
    nodes, e = spark.createDataFrame(list(taus.items()), "node_id int, tau double"), spark.createDataFrame(edges, "source int, target int, weight double, polarity int")
    a = {r.node_id: r.strength for r in Q.solve_acyclic(nodes, e).collect()}
    b = {r.node_id: r.strength for r in Q.solve_cyclic(nodes, e, still=1e-4).collect()}
    assert all(abs(a[k] - b[k]) < 1e-3 for k in taus)


def test_levels_still_know_cycles(spark):
    with pytest.raises(ValueError):
        G.levels(spark.createDataFrame([(1, 2), (2, 1)], "source int, target int"))


def test_betweenness_stores_no_pairs(spark, monkeypatch):
    """The sent graph gives what the joins give, and no written table is larger than the graph."""
    edges = [(f"n{i}", f"n{(i * i + k) % 50}") for i in range(50) for k in (1, 7, 20)] + [("a", "b"), ("b", "n3"), ("n3", "n3")]
    df = spark.createDataFrame(edges, "source string, target string")
    cuts, write = [], G.cut
    monkeypatch.setattr(G, "cut", lambda d: cuts.append(write(d)) or cuts[-1])
    monkeypatch.setattr(G, "_HELD_PAIRS", 200)
    got = {r.node_id: r.score for r in G.betweenness(df).collect()}
    assert max(c.count() for c in cuts) <= len(edges)
    monkeypatch.setattr(G, "_SENT_EDGES", 0)
    want = {r.node_id: r.score for r in G.betweenness(df).collect()}
    assert got.keys() == want.keys() and max(want.values()) > 0
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_sources_followed_by_the_same_nodes_are_walked_once(spark, monkeypatch):
    import numpy as np

    def brandes(edges):
        near = defaultdict(list)
        for a, b in edges:
            near[a].append(b)
        score = dict.fromkeys({x for e in edges for x in e}, 0.0)
        for s in score:
            dist, paths, order, before = {s: 0}, Counter({s: 1}), [s], defaultdict(list)
            for v in order:
                for w in near[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
                        before[w].append(v)
            gain = Counter()
            for w in reversed(order):
                for v in before[w]:
                    gain[v] += paths[v] / paths[w] * (1 + gain[w])
                score[w] += gain[w] if w != s else 0
        return score

    rng, n = random.Random(3), 14
    base = {(a, b) for a in range(n) for b in rng.sample(range(n), rng.choice([0, 1, 3])) if a != b}
    # Copies that nothing leads to, and a node within the graph that the same nodes follow as another.
    edges = sorted(base | {(a + 100 * k, b) for a, b in base for k in range(1, 9)} | {(50, b) for a, b in base if a == 2} | {(5, 50), (50, 9), (2, 9)})
    df = spark.createDataFrame(edges, "source int, target int")
    got, want = {r.node_id: r.score for r in G.betweenness(df, normalized=False).collect()}, brandes(edges)
    assert got == pytest.approx(want, abs=1e-9) and max(want.values()) > 0

    ids, ends = np.unique(np.array(edges).T, return_inverse=True)
    source, heads = ends.reshape(2, -1)
    first = G._alike(np.append(0, np.cumsum(np.bincount(source, minlength=len(ids)))), heads)
    follow = {v: tuple(sorted(b for a, b in edges if a == v)) for v in ids.tolist()}
    assert [follow[x] for x in ids[first].tolist()] == [follow[x] for x in ids.tolist()] and len(set(first.tolist())) == len(set(follow.values())) <= n + 1
