"""Communities of an undirected weighted graph by modularity: local moves, refinement, folding, and a hierarchy of bounded ones.

The state is a table of nodes, ``node, part, m2, gamma, k, c``: the graph that a node belongs to with twice its weight and its
resolution, the node's degree and its community.  Several graphs (parts) are worked on in one plan; no edge joins two.
A round moves one hash class of nodes, each to the neighbouring community of highest gain, by joins and aggregates; a sweep of
rounds counts only if modularity has grown, so the result never gets worse.  Nothing depends on how rows are partitioned.

A round of a small graph costs eight exchanges and no work, so parts of at most ``BLOCK`` pairs of nodes are each settled in a
task, all of them in one job, and so are denser ones of up to ``DENSE``; a larger part is moved and folded by rounds until it is that small.
Rounds of up to ``SENT`` nodes are passes over stored neighbours (:mod:`argloom.operators.sweeps`); more are joined.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.operators.graph import components
from argloom.operators.iterate import cut, freed
from argloom.operators.sweeps import partition_by_sweeps

CLASSES, MAX_SWEEPS, MAX_LEVELS = 2, 12, 20
#: Pairs of nodes of a part that one task may take.
BLOCK = 1 << 17
#: Pairs of a part that one task may take if its nodes have so many neighbours at least that its arrays pay, and nodes that are sent to tasks at most.
DENSE, NEIGHBOURS, SENT = 1 << 20, 64, 1 << 20
_STATE = ["node", "part", "m2", "gamma", "k", "c"]


def _class(node: str, sweep: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(sweep)), F.lit(CLASSES))


def _pairs(edges: DataFrame, floor: float) -> DataFrame:
    """``a, b, w, part`` (all in part 0) with ``a <= b``: parallel and opposite edges summed; a weight below the floor counts as the floor, none as 1."""
    w = F.greatest(F.lit(floor), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    return edges.filter("source IS NOT NULL AND target IS NOT NULL").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(w).alias("w")).withColumn("part", F.lit(0))


def _both(pairs: DataFrame) -> DataFrame:
    """``node, other, w`` of the pairs of different nodes, from both ends."""
    apart = pairs.filter("a <> b")
    return apart.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(apart.select(F.col("b").alias("node"), F.col("a").alias("other"), "w"))


def _degrees(pairs: DataFrame) -> DataFrame:
    """``node, k``; a loop counts twice."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))


def _quality(both: DataFrame, nodes: DataFrame) -> float:
    """The sum of the parts' modularities, without the loops' share, which moves do not change."""
    at = nodes.select("node", "c", "m2")
    inside = both.join(at, "node").join(at.select(F.col("node").alias("other"), F.col("c").alias("d")), "other").filter("c = d").agg(F.sum(F.col("w") / F.col("m2")).alias("q"))
    totals = nodes.groupBy("c").agg(F.sum("k").alias("t"), F.first("m2").alias("m2"), F.first("gamma").alias("g"))
    spread = totals.agg(F.sum(F.col("g") * (F.col("t") / F.col("m2")) ** 2).alias("s"))
    q, s = inside.crossJoin(spread).first()  # one row each
    return (q or 0.0) - (s or 0.0)


def _move(both: DataFrame, nodes: DataFrame, sweep: int, turn: int) -> DataFrame:
    """Moves the nodes of one class to the community where modularity gains most, if it gains; of two lone nodes only the larger id goes to the smaller."""
    mine = nodes.filter(_class("node", sweep) == turn)
    near = both.filter(_class("node", sweep) == turn).join(nodes.select(F.col("node").alias("other"), "c"), "other")
    links = near.select("node", "c", "w").unionByName(mine.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
    totals = nodes.groupBy("c").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
    own = mine.join(totals.select("c", F.col("n").alias("own_n")), "c").select("node", F.col("c").alias("own"), "own_n", "k", "m2", "gamma")
    stays = F.col("c") == F.col("own")
    option = links.join(totals, "c").join(own, "node").filter(stays | (F.col("own_n") > 1) | (F.col("n") > 1) | (F.col("c") < F.col("own")))
    gain = F.round(F.col("w") / F.col("m2") - F.col("gamma") * F.col("k") * (F.col("t") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m2") ** 2, 15)
    best = option.withColumn("gain", gain).groupBy("node").agg(F.min_by("c", F.struct(-F.col("gain"), ~stays, "c")).alias("to"))
    return cut(nodes.join(best, "node", "left").select(*_STATE[:5], F.coalesce("to", "c").alias("c")))


def _settle(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sweeps until modularity grows no more."""
    quality = _quality(both, nodes)
    for sweep in range(MAX_SWEEPS):
        new = nodes
        for turn in range(CLASSES):
            new = _move(both, new, sweep, turn)
        now = _quality(both, new)
        if now <= quality + 1e-9:
            break
        nodes, quality = new, now
    return nodes


def _refine(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``r``, connected parts of the communities: lone nodes join the neighbouring part within their community that gains most, round by round.

    In a round only the lone nodes of one class move, and never to another of them, so a part grows by neighbours of its members alone.
    """
    new = nodes.withColumn("r", F.col("node"))
    for turn in range(CLASSES):
        parts = new.groupBy("r").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
        state = new.join(parts, "r").withColumn("lone", (F.col("n") == 1) & (_class("r", -1) == turn))
        movers = state.filter("lone").select("node", F.col("c").alias("own"), "k", "m2", "gamma")
        targets = state.filter("NOT lone").select(F.col("node").alias("other"), "c", "r", "t")
        links = both.join(movers, "node").join(targets, "other").filter("c = own").groupBy("node", "r").agg(F.sum("w").alias("w"), *(F.first(x).alias(x) for x in ("k", "m2", "gamma", "t")))
        gain = F.round(F.col("w") / F.col("m2") - F.col("gamma") * F.col("k") * F.col("t") / F.col("m2") ** 2, 15)
        best = links.withColumn("gain", gain).filter("gain > 0").groupBy("node").agg(F.min_by("r", F.struct(-F.col("gain"), "r")).alias("to"))
        new = cut(new.join(best, "node", "left").select(*_STATE, F.coalesce("to", "r").alias("r")))
    return new


def _fold(pairs: DataFrame, nodes: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The graph of the groups ``by``; the communities of the folded nodes are those of their members, named after the least group."""
    to = nodes.select("node", by)
    ends = pairs.join(to.select(F.col("node").alias("a"), F.col(by).alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col(by).alias("y")), "b")
    folded = cut(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"), F.first("part").alias("part")))
    groups = nodes.groupBy(F.col(by).alias("node")).agg(*(F.first(x).alias(x) for x in ("part", "m2", "gamma")), F.sum("k").alias("k"), F.first("c").alias("old"))
    names = groups.groupBy("old").agg(F.min("node").alias("c"))
    return folded, cut(groups.join(names, "old").select(*_STATE))


def _moved(near: list, k: list, c: list, total: dict, m2: float, gamma: float) -> None:
    """Moves nodes one by one to the neighbouring community that gains most, until none gains; changes ``c`` and ``total``."""
    moved = True
    while moved:
        moved = False
        for v in range(len(k)):
            links = defaultdict(float)
            for u, w in near[v].items():
                links[c[u]] += w
            own = c[v]
            total[own] -= k[v]
            gain = lambda x: links.get(x, 0.0) / m2 - gamma * k[v] * total[x] / m2**2  # noqa: B023, E731
            best, most = own, gain(own) + 1e-12
            for x in sorted(links):
                g = gain(x)
                if g > most:
                    best, most = x, g + 1e-15
            total[best] += k[v]
            moved |= best != own
            c[v] = best


def _parts(near: list, k: list, c: list, m2: float, gamma: float) -> list:
    """Connected parts of the communities: a lone node joins the neighbouring part within its community that gains most."""
    r, size, total = list(range(len(k))), [1] * len(k), dict(enumerate(k))
    for v in range(len(k)):
        if size[r[v]] > 1:
            continue
        links = defaultdict(float)
        for u, w in near[v].items():
            if c[u] == c[v]:
                links[r[u]] += w
        best, most = None, 1e-15
        for x in sorted(links):
            g = links[x] / m2 - gamma * k[v] * total[x] / m2**2
            if g > most:
                best, most = x, g + 1e-15
        if best is not None:
            total[best] += k[v]
            size[best] += 1
            size[v], r[v] = 0, best
    return r


def _in_arrays(ids: np.ndarray, other: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, other, w``: the neighbours of node v are ``other[at[v] : at[v + 1]]``, in order; both directions are given once each."""
    order = np.argsort(ids * n + other, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n))]), other[order], w[order]


def _moved_dense(near: tuple, k: np.ndarray, c: np.ndarray, m2: float, gamma: float) -> None:
    """:func:`_moved` with arrays."""
    at, other, w = near
    n = len(k)
    total = np.bincount(c, k, n)
    moved = True
    while moved:
        moved = False
        for v in range(n):
            i, j = at[v], at[v + 1]
            links = np.bincount(c[other[i:j]], w[i:j], n)
            own = c[v]
            total[own] -= k[v]
            there = np.flatnonzero(links)
            gain = links[there] / m2 - gamma * k[v] * total[there] / m2**2
            if len(there) and gain[x := int(gain.argmax())] > links[own] / m2 - gamma * k[v] * total[own] / m2**2 + 1e-12:
                c[v] = there[x]
                moved = True
            total[c[v]] += k[v]


def _parts_dense(near: tuple, k: np.ndarray, c: np.ndarray, m2: float, gamma: float) -> np.ndarray:
    """:func:`_parts` with arrays."""
    at, other, w = near
    n = len(k)
    r, size, total = np.arange(n), np.ones(n, np.int64), k.astype(float).copy()
    for v in range(n):
        if size[r[v]] > 1:
            continue
        i, j = at[v], at[v + 1]
        same = c[other[i:j]] == c[v]
        links = np.bincount(r[other[i:j][same]], w[i:j][same], n)
        there = np.flatnonzero(links)
        gain = links[there] / m2 - gamma * k[v] * total[there] / m2**2
        if len(there) and gain[x := int(gain.argmax())] > 1e-15:
            to = there[x]
            total[to] += k[v]
            size[to] += 1
            size[v], r[v] = 0, to
    return r


def _settled_dense(ids: np.ndarray, other: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, m2: float, gamma: float, refine: bool) -> np.ndarray:
    """What :func:`_settled_part` does for a part with many neighbours a node; gives a community per node."""
    n = len(k)
    near = _in_arrays(np.concatenate([ids, other]), np.concatenate([other, ids]), np.concatenate([w, w]), n)
    top = np.arange(n)
    while True:
        _moved_dense(near, k, c, m2, gamma)
        by = _parts_dense(near, k, c, m2, gamma) if refine else c
        groups, to = np.unique(by, return_inverse=True)
        if len(groups) == len(k) or len(np.unique(c)) == len(k):
            return c[top]
        at, other, w = near
        x, y = np.repeat(to, np.diff(at)), to[other]
        apart = x != y
        key, inverse = np.unique(x[apart] * len(groups) + y[apart], return_inverse=True)
        near = _in_arrays(key // len(groups), key % len(groups), np.bincount(inverse, w[apart], len(key)), len(groups))
        first = np.unique(to, return_index=True)[1]
        k, c, top = np.bincount(to, k), np.unique(c[first], return_inverse=True)[1], to[top]


def _connected_dense(ids: np.ndarray, other: np.ndarray, c: np.ndarray) -> np.ndarray:
    """:func:`_connected` with arrays."""
    label = np.arange(len(c))
    same = c[ids] == c[other]
    ids, other = ids[same], other[same]
    while True:
        x, y = label[ids], label[other]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def _connected(near: list, c: list) -> list:
    """For every node the least node of its community that it reaches within it."""
    found = [-1] * len(c)
    for v in range(len(c)):
        if found[v] < 0:
            found[v], stack = v, [v]
            while stack:
                x = stack.pop()
                for u in near[x]:
                    if found[u] < 0 and c[u] == c[v]:
                        found[u] = v
                        stack.append(u)
    return found


def _settled_part(refine: bool):
    """Communities of one part, from its nodes and pairs: local moves and folding until nothing joins."""

    def run(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node", ignore_index=True)
        if nodes.empty:
            return pd.DataFrame({"node": nodes["node"], "c": nodes["node"]})
        ids, m2, gamma = pd.Index(nodes["node"]), float(nodes["m2"].iloc[0]), float(nodes["gamma"].iloc[0])
        pairs = pairs[pairs["a"] != pairs["b"]].sort_values(["a", "b"])
        c = np.unique(nodes["c"].to_numpy(), return_inverse=True)[1]
        if 2 * len(pairs) >= NEIGHBOURS * len(nodes):
            a, b = ids.get_indexer(pairs["a"]), ids.get_indexer(pairs["b"])
            c = _settled_dense(a, b, pairs["w"].to_numpy(float), nodes["k"].to_numpy(float), c, m2, gamma, refine)
            return pd.DataFrame({"node": nodes["node"], "c": nodes["node"].to_numpy()[_connected_dense(a, b, c)]})
        first = near = [{} for _ in range(len(nodes))]
        for a, b, w in zip(ids.get_indexer(pairs["a"]).tolist(), ids.get_indexer(pairs["b"]).tolist(), pairs["w"].tolist(), strict=True):
            near[a][b] = near[b][a] = w
        k, c = nodes["k"].tolist(), c.tolist()
        top = list(range(len(k)))
        while True:
            total = defaultdict(float)
            for v, x in enumerate(c):
                total[x] += k[v]
            _moved(near, k, c, total, m2, gamma)
            by = _parts(near, k, c, m2, gamma) if refine else c
            groups = {g: i for i, g in enumerate(sorted(set(by)))}
            if len(groups) == len(k) or len(set(c)) == len(k):
                break
            to = [groups[g] for g in by]
            folded, sums, new_c = [defaultdict(float) for _ in groups], [0.0] * len(groups), [0] * len(groups)
            for v, links in enumerate(near):
                sums[to[v]] += k[v]
                new_c[to[v]] = c[v]
                for u, w in links.items():
                    if to[u] != to[v]:
                        folded[to[v]][to[u]] += w
            near, k, c, top = folded, sums, new_c, [to[t] for t in top]
        return pd.DataFrame({"node": nodes["node"], "c": nodes["node"].to_numpy()[_connected(first, [c[t] for t in top])]})

    return run


def _in_tasks(pairs: DataFrame, nodes: DataFrame, refine: bool) -> DataFrame:
    """``node, c`` of parts that are small, each part in one task."""
    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.groupBy("part").cogroup(pairs.groupBy("part")).applyInPandas(_settled_part(refine), f"node {kind}, c {kind}")


def _large(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``part`` of those that no task takes."""
    n, few = F.col("count"), F.col("_n")
    sizes = pairs.groupBy("part").count().join(nodes.groupBy("part").agg(F.count("*").alias("_n")), "part")
    return sizes.filter((n > BLOCK) & ((n > DENSE) | (2 * n < NEIGHBOURS * few))).select("part")


def _by_rounds(pairs: DataFrame, nodes: DataFrame, refine: bool) -> DataFrame:
    """``node_id, community`` of parts that are large: moved and folded by rounds until they are small."""
    if nodes.count() <= SENT:
        freed(pairs.sparkSession)
        return partition_by_sweeps(pairs, nodes, refine, lambda p, v: _large(p, v).isEmpty(), _in_tasks)
    whole = pairs
    nodes = cut(nodes.withColumn("c", F.col("node")).select(*_STATE))
    member = nodes.select(F.col("node").alias("node_id"), F.col("node").alias("top"))
    for _ in range(MAX_LEVELS):
        settled = _settle(_both(pairs), nodes)
        by = "c"
        if refine:
            settled, by = _refine(_both(pairs), settled), "r"
        member = cut(member.join(settled.select(F.col("node").alias("top"), F.col(by).alias("_g"), "c"), "top").select("node_id", F.col("_g").alias("top"), F.col("c").alias("community")))
        before, groups, found = settled.agg(F.count("*"), F.count_distinct(by), F.count_distinct("c")).first()
        if groups == before or found == before:
            break
        pairs, nodes = _fold(pairs, settled, by)
        member = member.select("node_id", "top")
        if _large(pairs, nodes).isEmpty():
            last = _in_tasks(pairs, nodes, refine)
            member = cut(member.join(last.select(F.col("node").alias("top"), F.col("c").alias("community")), "top").select("node_id", "community"))
            break
    if "community" not in member.columns:
        member = member.join(nodes.select(F.col("node").alias("top"), F.col("c").alias("community")), "top").select("node_id", "community")
    at = member.select("node_id", "community")
    inside = whole.filter("a <> b").join(at.select(F.col("node_id").alias("a"), F.col("community").alias("x")), "a").join(at.select(F.col("node_id").alias("b"), F.col("community").alias("y")), "b").filter("x = y").select(F.col("a").alias("source"), F.col("b").alias("target"))
    connected = components(inside).select("node_id", F.col("component").alias("_c"))
    return at.join(connected, "node_id", "left").select("node_id", F.coalesce("_c", "node_id").alias("community"))


def _partition(pairs: DataFrame, nodes: DataFrame, refine: bool) -> DataFrame:
    """``node_id, community`` of all parts: local moves, folding of what they (or the refinement) put together, until nothing joins."""
    nodes = cut(nodes)
    large = cut(_large(pairs, nodes))
    small = lambda df: df.join(large, "part", "left_anti")
    found = cut(_in_tasks(small(pairs), small(nodes).withColumn("c", F.col("node")), refine).select(F.col("node").alias("node_id"), F.col("c").alias("community")))
    if large.isEmpty():
        return found
    return found.unionByName(_by_rounds(pairs.join(large, "part", "left_semi"), nodes.join(large, "part", "left_semi"), refine))


def communities(edges: DataFrame, resolution: float = 1.0, refine: bool = False, floor: float = 0.01) -> DataFrame:
    """``node_id, community`` (its least node) of ``edges(source, target, weight)`` taken as undirected: Louvain, or Leiden with ``refine``.

    Edges between the same nodes add up; a missing weight counts as 1, one below ``floor`` as ``floor``; edges without an
    end are left out, loops count in degrees.  Every community is connected.  No edges give no rows.  The result is
    deterministic: classes of nodes come from hashes, ties go to the smaller id.
    """
    return _whole(cut(_pairs(edges, floor)), resolution, refine)


def _whole(pairs: DataFrame, resolution: float, refine: bool) -> DataFrame:
    degrees = _degrees(pairs)
    whole = pairs.agg((2 * F.sum("w")).alias("m2"))
    nodes = degrees.join(F.broadcast(whole), F.lit(True)).select("node", F.lit(0).alias("part"), "m2", F.lit(float(resolution)).alias("gamma"), "k")
    return _partition(pairs, nodes, refine)


def hierarchy(edges: DataFrame, limit: int = 100, resolution: float = 1.0, floor: float = 0.01) -> DataFrame:
    """``node_id, level, community, parent, final``: Leiden communities, and below each one with more than ``limit`` nodes the communities of its own subgraph, level by level.

    All oversize communities of a level are split in one plan, each as a graph of its own.  One that modularity would leave
    whole is split at twice the resolution in the next level, so that no final community has more than ``limit`` nodes.
    ``parent`` is null at level 0; ``final`` marks the rows of communities that are split no further.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    pairs = cut(_pairs(edges, floor))
    found = _whole(pairs, resolution, True).select("node_id", F.lit(0).alias("level"), "community", F.lit(None).cast(edges.schema["source"].dataType).alias("parent"), F.lit(float(resolution)).alias("gamma"), F.lit(-1).cast("bigint").alias("of"))
    level, done = 0, None
    while True:
        size = found.groupBy("community").agg(F.count("*").alias("n"))
        found = cut(found.join(size, "community").select("node_id", "level", "community", "parent", "gamma", "of", "n", (F.col("n") <= limit).alias("final")))
        done = found if done is None else done.unionByName(found)
        open_ = found.filter("NOT final")
        if open_.isEmpty():
            return done.drop("gamma", "of", "n")
        level += 1
        part = open_.select("node_id", F.col("community").alias("part"), F.when(F.col("n") == F.col("of"), 2 * F.col("gamma")).otherwise(F.col("gamma")).alias("gamma"), F.col("n").alias("of"))
        at = part.select("node_id", "part")
        inner = cut(pairs.drop("part").join(at.select(F.col("node_id").alias("a"), "part"), "a").join(at.select(F.col("node_id").alias("b"), F.col("part").alias("y")), "b").filter("part = y").select("a", "b", "w", "part"))
        weight = inner.groupBy("part").agg((2 * F.sum("w")).alias("m2"))
        nodes = part.withColumnRenamed("node_id", "node").join(_degrees(inner), "node").join(weight, "part").select("node", "part", "m2", "gamma", "k")
        split = _partition(inner, nodes, True)
        found = split.join(part, "node_id").select("node_id", F.lit(level).alias("level"), "community", F.col("part").alias("parent"), "gamma", "of")
