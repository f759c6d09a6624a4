"""Graph operators on ``edges(source, target[, weight])`` and ``nodes(node_id)``.

Every round of an iterative operator is a plan of joins and aggregates, cut by a checkpoint; only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argloom.operators.iterate import cut

#: Edges of a graph that is sent to tasks at most (16 bytes each), pairs of a group of sources and a node that a task holds at a time, and steps along edges of a task.
_SENT_EDGES, _HELD_PAIRS, _TASK_STEPS = 1 << 22, 1 << 19, 10**8
_LEAST_TASKS = 24


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id"))).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *rest)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reversed_edges(edges))


def hops(edges: DataFrame, seeds: DataFrame, most: int = 50) -> DataFrame:
    """Breadth-first distances ``node_id, hop`` from the seeds along the edges, seeds at 0."""
    e = cut(edges.select("source", "target").distinct())
    seen = cut(seeds.select("node_id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, most + 1):
        step = frontier.join(e, F.col("node_id") == F.col("source")).select(F.col("target").alias("node_id")).distinct()
        frontier = cut(step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expand(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges between nodes within ``depth`` undirected hops of the seeds."""
    near = hops(undirected(edges.select("source", "target")), seeds, depth).select("node_id")
    out = edges
    for end in ("source", "target"):
        out = out.join(near.withColumnRenamed("node_id", end), end, "left_semi")
    return out


def closure(edges: DataFrame) -> DataFrame:
    """All pairs ``source, target`` joined by a path of one edge or more; paths double in length each round."""
    paths = cut(edges.select("source", "target").distinct())
    count = paths.count()
    while True:
        longer = paths.select("source", F.col("target").alias("via")).join(paths.select(F.col("source").alias("via"), "target"), "via").select("source", "target")
        paths = cut(paths.unionByName(longer).distinct())
        if (now := paths.count()) == count:
            return paths
        count = now


def reduction(edges: DataFrame) -> DataFrame:
    """Of a DAG: the edges that no longer path replaces."""
    e = edges.select("source", "target").distinct()
    longer = e.select("source", F.col("target").alias("via")).join(closure(e).select(F.col("source").alias("via"), "target"), "via").select("source", "target").distinct()
    return e.join(longer, ["source", "target"], "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """Of a DAG: ``node_id, level``, the longest path from a root; raises on a cycle."""
    e = cut(edges.select("source", "target").distinct())
    left, level, done = cut(ends(e)), 0, None
    while not left.isEmpty():
        live = e.join(left.withColumnRenamed("node_id", "source"), "source", "left_semi")
        roots = cut(left.join(live.select(F.col("target").alias("node_id")), "node_id", "left_anti").withColumn("level", F.lit(level)))
        if roots.isEmpty():
            raise ValueError("the graph has a cycle")
        done = roots if done is None else done.unionByName(roots)
        left = cut(left.join(roots, "node_id", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges."""
    return ends(edges).join(edges.select(F.col("target").alias("node_id")), "node_id", "left_anti")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves; empty for a DAG."""
    return closure(edges).filter("source = target").select(F.col("source").alias("node_id"))


def components(edges: DataFrame) -> DataFrame:
    """Weak components ``node_id, component`` (the least id of each), by least-neighbour propagation with shortcuts."""
    both = cut(undirected(edges.select("source", "target")).distinct())
    label = cut(ends(edges).withColumn("component", F.col("node_id")))
    while True:
        near = both.join(label.withColumnRenamed("node_id", "source"), "source").groupBy(F.col("target").alias("node_id")).agg(F.min("component").alias("m"))
        new = label.join(near, "node_id", "left").select("node_id", F.least("component", F.coalesce("m", "component")).alias("component"))
        short = new.join(new.select(F.col("node_id").alias("component"), F.col("component").alias("c2")), "component").select("node_id", F.col("c2").alias("component"))
        short = cut(short)
        if short.join(label, ["node_id", "component"], "left_anti").isEmpty():
            return short
        label = short


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Weighted PageRank ``node_id, score``; the mass of nodes without outgoing edges is spread over all.  ``tolerance`` None: exactly ``rounds`` rounds."""
    e = edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    e = cut(e.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("source"))).select("source", "target", "share"))
    all_nodes = cut(ends(e))
    n = all_nodes.count()
    score = all_nodes.withColumn("score", F.lit(1.0 / max(n, 1)))
    out = e.select(F.col("source").alias("node_id")).distinct()
    for _ in range(rounds):
        lost = score.join(out, "node_id", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        got = e.join(score.withColumnRenamed("node_id", "source"), "source").groupBy(F.col("target").alias("node_id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = all_nodes.join(got, "node_id", "left").join(F.broadcast(lost), F.lit(True)).select("node_id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        new = cut(new)
        if tolerance is not None and new.join(score.withColumnRenamed("score", "old"), "node_id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < n * tolerance:
            return new
        score = new
    if tolerance is not None:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return score


def eigenvector(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Eigenvector centrality by power iteration on the summed adjacency plus identity, with unit length."""
    e = cut(edges.groupBy("source", "target").agg(F.sum("weight").alias("weight")))
    all_nodes = cut(ends(e))
    x = all_nodes.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        got = e.join(x.withColumnRenamed("node_id", "source"), "source").groupBy(F.col("target").alias("node_id")).agg(F.sum(F.col("score") * F.col("weight")).alias("got"))
        new = x.join(got, "node_id", "left").select("node_id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score"))
        norm = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
        x = cut(new.join(F.broadcast(norm), F.lit(True)).select("node_id", (F.col("score") / F.col("norm")).alias("score")))
    return x


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges ``starts[i] .. starts[i] + counts[i] - 1``, one after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _alike(at: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each node the first one that is followed by the same nodes (``heads`` are sorted within a node)."""
    n, count = len(at) - 1, np.diff(at)
    random = np.random.default_rng(7)
    words = [random.integers(0, 1 << 63, n, dtype=np.uint64)[heads] for _ in range(2)]
    keys = [count, *(np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(w)])[at]) for w in words)]
    order = np.lexsort((np.arange(n), *keys))
    new = np.concatenate([[True], *([np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)] if n > 1 else [])])
    first = np.empty(n, np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    # Hashes only say which nodes to compare.
    differ = heads != heads[_ranges(at[first], count)]
    node = np.repeat(np.arange(n), count)[differ]
    first[node] = node
    return first


def _dependencies(groups: np.ndarray, out: tuple[np.ndarray, np.ndarray], members: tuple[np.ndarray, np.ndarray], times: np.ndarray, at: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """What each node gains from the shortest paths of the sources in the groups; ``heads[at[v] : at[v + 1]]`` follow node v.

    The sources of a group are followed by the same nodes, ``out``, so their shortest paths differ in nothing but the source: a
    path that came back to one of them could begin there.  They are walked once, for ``times`` sources; a node that is
    one of them (``members``) is an end for the others only.  A pair of group and node is a place in flat arrays, so the levels
    of several groups are walked at once; of a level only the places that are there have paths and gains.
    """
    n = len(at) - 1
    seen, place = np.zeros(len(groups) * n, bool), np.empty(len(groups) * n, np.int32)
    count = out[0][groups + 1] - out[0][groups]
    base = np.repeat(np.arange(len(groups)) * n, count)
    node = out[1][_ranges(out[0][groups], count)]
    seen[base + node] = True
    levels, links, paths = [(base, node)], [], [np.ones(len(node))]
    while len(node):
        count = at[node + 1] - at[node]
        own = np.repeat(np.arange(len(node), dtype=np.int32), count)
        to, start = heads[_ranges(at[node], count)], base[own]
        new = np.flatnonzero(~seen[to + start])
        own, to, start = own[new], to[new], start[new]
        flat = to + start
        seen[flat] = True
        place[flat] = np.arange(len(flat), dtype=np.int32)
        one = np.flatnonzero(place[flat] == np.arange(len(flat), dtype=np.int32))
        base, node = start[one], to[one]
        place[flat[one]] = np.arange(len(one), dtype=np.int32)
        to = place[flat]
        links.append((own, to))
        paths.append(np.bincount(to, paths[-1][own], len(one)))
        levels.append((base, node))
    one_of = np.zeros(len(groups) * n, bool)
    count = members[0][groups + 1] - members[0][groups]
    one_of[np.repeat(np.arange(len(groups)) * n, count) + members[1][_ranges(members[0][groups], count)]] = True
    total, delta = np.zeros(n), np.zeros(len(levels[-1][1]))
    for d in range(len(levels) - 2, -1, -1):
        (own, to), (base, node) = links[d], levels[d + 1]
        gain = (times[groups[base // n]] - one_of[base + node] + delta) / paths[d + 1]
        delta = paths[d] * np.bincount(own, gain[to], len(paths[d]))
        total += np.bincount(levels[d][1], delta, n)
    return total


def _from_sent_graph(e: DataFrame) -> DataFrame:
    """``node_id, delta`` summed over all sources: the graph is sent to tasks that each take some of the sources, so no pair is stored.

    Sent are the nodes that some edge leads to and the edges between them: walks see no others once they have begun.
    """
    table = e.toArrow()
    both = np.concatenate([table.column(c).to_numpy(zero_copy_only=False) for c in ("source", "target")])
    ids, ends_ = np.unique(both, return_inverse=True)
    kind, (source, target) = table.schema.field("source").type, np.split(ends_, 2)
    n = len(ids)
    order = np.lexsort((target, source))
    source, target = source[order], target[order]
    starts = lambda of, n: np.append(0, np.cumsum(np.bincount(of, minlength=n)))
    reached, target = np.unique(target, return_inverse=True)
    core = np.full(n, -1)
    core[reached] = np.arange(len(reached))
    at = starts(source, n)
    leaders, group = np.unique(_alike(at, target), return_inverse=True)
    followed = np.diff(at)[leaders] > 0  # a node without edges begins no walk
    inner = core[source] >= 0
    member = reached[np.argsort(group[reached], kind="stable")]
    out = np.append(0, np.cumsum(np.diff(at)[leaders])), target[_ranges(at[leaders], np.diff(at)[leaders])]
    members = starts(group[member], len(leaders)), core[member]
    graph = starts(core[source[inner]], len(reached)), target[inner]
    sent = e.sparkSession.sparkContext.broadcast((out, members, np.bincount(group, minlength=len(leaders)), *graph, np.flatnonzero(followed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, members, times, at, heads, walks = sent.value
        total, some = np.zeros(len(at) - 1), max(1, _HELD_PAIRS // max(len(at) - 1, 1))
        for batch in batches:
            groups = walks[batch.column(0).to_numpy()]
            for i in range(0, len(groups), some):
                total += _dependencies(groups[i : i + some], out, members, times, at, heads)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["i", "delta"])

    walks = int(followed.sum())
    tasks = min(max(walks, 1), max(_LEAST_TASKS, walks * len(graph[1]) // _TASK_STEPS))
    gained = e.sparkSession.range(0, walks, 1, tasks).mapInArrow(run, "i bigint, delta double").groupBy("i").agg(F.sum("delta").alias("delta"))
    names = e.sparkSession.createDataFrame(pa.table({"i": pa.array(np.arange(len(reached))), "node_id": pa.array(ids[reached], kind)}))
    return gained.join(names, "i").select(F.col("node_id").cast(e.schema["source"].dataType).alias("node_id"), "delta")


def _from_stored_pairs(e: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """``node_id, delta``, by joins: all pairs of a source and a node that it reaches are stored."""
    found = cut(all_nodes.select(F.col("node_id").alias("s"), F.col("node_id").alias("v"), F.lit(0).alias("dist"), F.lit(1.0).alias("paths")))
    frontier, depth = found, 0
    while True:
        step = frontier.join(e, F.col("v") == F.col("source")).groupBy("s", F.col("target").alias("v")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(found.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(depth + 1).alias("dist"), "paths"))
        if new.isEmpty():
            break
        depth += 1
        found, frontier = cut(found.unionByName(new)), new
    gained = found.filter(F.col("dist") == depth).select("s", "v", "paths", F.lit(0.0).alias("delta"))
    total = gained
    for d in range(depth - 1, -1, -1):
        back = gained.join(e.withColumnRenamed("target", "v"), "v").select("s", F.col("source").alias("v"), ((1 + F.col("delta")) / F.col("paths")).alias("part"))
        level = found.filter(F.col("dist") == d)
        parts = level.join(back, ["s", "v"]).groupBy("s", "v").agg(F.sum("part").alias("part"))
        gained = cut(level.join(parts, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("delta")))
        total = total.unionByName(gained)
    return total.filter("s <> v").select(F.col("v").alias("node_id"), "delta")


def betweenness(edges: DataFrame, normalized: bool = True) -> DataFrame:
    """Betweenness of a directed graph: shortest-path counts by levels from many sources at once, then dependencies back, level by level.

    Sources that the same nodes follow are walked once, over the nodes that edges lead to; without such the work grows with nodes times edges.  A graph of at most ``_SENT_EDGES`` edges is sent to the tasks; beyond that it is joined.
    """
    e = cut(edges.select("source", "target").filter("source <> target").distinct())
    all_nodes = cut(ends(e))
    n, count = all_nodes.count(), e.count()
    total = _from_sent_graph(e) if count <= _SENT_EDGES else _from_stored_pairs(e, all_nodes)
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    summed = total.groupBy("node_id").agg((F.sum("delta") * scale).alias("score"))
    return all_nodes.join(summed, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Modularity of ``partition(node_id, community)`` on the undirected weighted graph, per community and so additive."""
    p = partition.select("node_id", "community")
    e = edges.select("source", "target", "weight").join(p.select(F.col("node_id").alias("source"), F.col("community").alias("ca")), "source").join(p.select(F.col("node_id").alias("target"), F.col("community").alias("cb")), "target")
    inside = e.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w_in"))
    degree = e.select(F.col("ca").alias("community"), "weight").unionByName(e.select(F.col("cb").alias("community"), "weight")).groupBy("community").agg(F.sum("weight").alias("deg"))
    whole = e.agg(F.sum("weight").alias("m"))
    return degree.join(inside, "community", "left").join(F.broadcast(whole), F.lit(True)).select("community", (F.coalesce("w_in", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2))).alias("part"))


def label_communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Communities by weighted label propagation in fixed order: even and odd node hashes move in turn to the label with most weight (ties: the least), so the outcome is deterministic."""
    both = cut(undirected(edges.filter("source <> target").select("source", "target", "weight")).groupBy("source", "target").agg(F.sum("weight").alias("weight")))
    label = cut(ends(edges).select("node_id", F.col("node_id").alias("community")))
    for k in range(rounds):
        pull = both.join(label.withColumnRenamed("node_id", "target"), "target").groupBy(F.col("source").alias("node_id"), "community").agg(F.sum("weight").alias("w"))
        best = pull.groupBy("node_id").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("best"))
        moves = F.pmod(F.xxhash64("node_id"), F.lit(2)) == k % 2
        new = cut(label.join(best, "node_id", "left").select("node_id", F.when(moves, F.coalesce("best", "community")).otherwise(F.col("community")).alias("community")))
        if k % 2 and new.join(label, ["node_id", "community"], "left_anti").isEmpty():
            return new
        label = new
    return label
