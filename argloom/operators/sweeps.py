"""Communities of a large graph with few enough nodes to send: neighbours are stored once a level, and each round is one pass over them.

A round moves one class of nodes.  The communities of all nodes are sent to the tasks, which read the neighbours of that class and
give back what moves, so no round joins or shuffles the pairs.  What the driver holds are arrays with an entry per node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import fsum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.operators.iterate import cut, freed, shared_folder

#: Classes of nodes that move in turn, sweeps and levels at most, and pairs of node and neighbour of a stored row and of a task.
CLASSES, MAX_SWEEPS, MAX_LEVELS, ENTRIES, TASK_ENTRIES = 8, 12, 20, 1 << 18, 1 << 20
_MIX = 2_654_435_761


def _class_of(i: np.ndarray) -> np.ndarray:
    return ((i.astype(np.int64) * _MIX >> 16) % CLASSES).astype(np.int8)


def _class_column(i: Column) -> Column:
    return F.pmod(F.shiftright(i.cast("bigint") * F.lit(_MIX), 16), F.lit(CLASSES)).cast("int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole nodes of one class with about :data:`ENTRIES` neighbours, in order, from all neighbours of a task's nodes."""
    parts = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches if batch.num_rows]
    if not parts:
        return
    node, other, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(node.astype(np.int64) << 32 | other, kind="stable")
    node, other, w = node[order], other[order], w[order]
    binary = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
    for cls in np.unique(of := _class_of(node)):
        here = np.flatnonzero(of == cls)
        first = np.flatnonzero(np.concatenate([[True], node[here][1:] != node[here][:-1]]))
        ends, i = np.append(first, len(here)), 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + ENTRIES, side="right")) - 1)
            rows = here[ends[i] : ends[j]]
            yield pa.RecordBatch.from_arrays([pa.array([cls], pa.int32()), binary(node[here[first[i:j]]], "<i4"), binary(np.diff(ends[i : j + 1]), "<i4"), binary(other[rows], "<i4"), binary(w[rows], "<f8")], names=["class", "nodes", "counts", "others", "ws"])
            i = j


class _Graph:
    """Neighbours of nodes ``0 .. n - 1``, stored by class; ``work`` of a pass gets arrays ``row, nodes, others, ws`` (the row of each entry within ``nodes``)."""

    def __init__(self, pairs: DataFrame, n: int, count: int):
        self.spark, self.n = pairs.sparkSession, n
        self.path = f"{shared_folder(self.spark)}/neighbours-{id(self)}-{np.random.default_rng().integers(1 << 62)}"
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "w"))
        each = max(1, -(-2 * count // (TASK_ENTRIES * CLASSES)))
        task = _class_column(F.col("node")) * each + F.pmod(F.xxhash64("node"), F.lit(each)).cast("int")
        rows = both.repartitionById(each * CLASSES, task).mapInArrow(_packed, "class int, nodes binary, counts binary, others binary, ws binary")
        rows.write.partitionBy("class").parquet(self.path)
        freed(self.spark)

    def passed(self, work: Callable, kinds: str, cls: int | None = None) -> DataFrame:
        stored = self.spark.read.schema("nodes binary, counts binary, others binary, ws binary, class int").parquet(self.path)
        stored = stored if cls is None else stored.filter(F.col("class") == cls)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    nodes, counts, others = (np.frombuffer(batch.column(k)[i].as_buffer(), "<i4") for k in range(3))
                    yield from work(np.repeat(np.arange(len(nodes)), counts), nodes, others, np.frombuffer(batch.column(3)[i].as_buffer(), "<f8"))

        return stored.select("nodes", "counts", "others", "ws").mapInArrow(run, kinds)


def _sums(row: np.ndarray, to: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, to`` once each, in order, with the sums of ``w``."""
    key = row * n + to
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first] // n, key[first] % n, np.add.reduceat(w[order], first) if len(first) else w[:0]


def _moving(sent, n: int):
    """``node, to`` of the nodes that gain by another community; of two lone nodes only the larger goes to the smaller."""

    def work(row: np.ndarray, nodes: np.ndarray, others: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, k, m2, gamma, total, size = sent.value
        own = c[nodes]
        alone = np.arange(len(nodes))
        at, to, links = _sums(np.concatenate([row, alone]), np.concatenate([c[others], own]), np.concatenate([w, np.zeros(len(nodes))]), n)
        v = nodes[at]
        stays = to == own[at]
        gain = np.round(links / m2[v] - gamma[v] * k[v] * (total[to] - np.where(stays, k[v], 0.0)) / m2[v] ** 2, 15)
        gain[~(stays | (size[own[at]] > 1) | (size[to] > 1) | (to < own[at]))] = -np.inf
        order = np.lexsort((to, ~stays, -gain, at))
        best = order[np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))]
        best = best[~stays[best]]
        yield pa.RecordBatch.from_arrays([pa.array(v[best]), pa.array(to[best].astype(np.int32))], names=["node", "to"])

    return work


def _joining(sent, n: int, turn: int):
    """``node, to`` of the lone nodes of class ``turn``, with the neighbouring part within their community that gains most."""

    def work(row: np.ndarray, nodes: np.ndarray, others: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, r, k, m2, gamma, total, size = sent.value
        lone = size[r[nodes]] == 1
        use = lone[row] & (c[others] == c[nodes[row]]) & ~((size[r[others]] == 1) & (_class_of(others) == turn))
        at, to, links = _sums(row[use], r[others[use]], w[use], n)
        v = nodes[at]
        gain = np.round(links / m2[v] - gamma[v] * k[v] * total[to] / m2[v] ** 2, 15)
        some = gain > 0
        at, v, to, gain = at[some], v[some], to[some], gain[some]
        order = np.lexsort((to, -gain, at))
        best = order[np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]])[: len(at)])]
        yield pa.RecordBatch.from_arrays([pa.array(v[best]), pa.array(to[best].astype(np.int32))], names=["node", "to"])

    return work


def _inside(sent):
    """The weight within communities, by row."""

    def work(row: np.ndarray, nodes: np.ndarray, others: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, m2 = sent.value
        same = c[others] == c[nodes[row]]
        yield pa.RecordBatch.from_arrays([pa.array([float(np.sum(w[same] / m2[nodes[row[same]]]))])], names=["q"])

    return work


def _folded(sent, n: int):
    """``a, b, w`` (``a < b``) of pairs of groups, summed within a row."""

    def work(row: np.ndarray, nodes: np.ndarray, others: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        (g,) = sent.value
        x, y = g[nodes[row]], g[others]
        once = (nodes[row] < others) & (x != y)
        a, b, w = _sums(np.minimum(x, y)[once].astype(np.int64), np.maximum(x, y)[once], w[once], n)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(w)], names=["a", "b", "w"])

    return work


def _lower(sent):
    """``node, to``: of each node the least label among itself and the neighbours of its community, where that is another."""

    def work(row: np.ndarray, nodes: np.ndarray, others: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, label = sent.value
        least = label[nodes].copy()
        same = c[others] == c[nodes[row]]
        np.minimum.at(least, row[same], label[others[same]])
        new = least < label[nodes]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(least[new])], names=["node", "to"])

    return work


def _asked(graph: _Graph, state: tuple, make: Callable, kinds: str = "node int, to int", cls: int | None = None) -> pa.Table:
    """All that a pass gives back: at most a row per node."""
    sent = graph.spark.sparkContext.broadcast(state)
    found = graph.passed(make(sent), kinds, cls).toArrow()
    sent.unpersist()
    return found


def _moves(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("node").to_numpy(), table.column("to").to_numpy()


def _settled(graph: _Graph, c: np.ndarray, k: np.ndarray, m2: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Sweeps until modularity grows no more."""
    n = graph.n

    def quality(c: np.ndarray) -> float:
        inside = fsum(_asked(graph, (c, m2), _inside, "q double").column("q").to_pylist())
        first = np.unique(c, return_index=True)[1]
        return inside - fsum((gamma[first] * (np.bincount(c, k, n)[c[first]] / m2[first]) ** 2).tolist())

    best = quality(c)
    for _ in range(MAX_SWEEPS):
        new, moved = c.copy(), 0
        for turn in range(CLASSES):
            state = (new, k, m2, gamma, np.bincount(new, k, n), np.bincount(new, minlength=n).astype(np.int32))
            node, to = _moves(_asked(graph, state, lambda sent: _moving(sent, n), cls=turn))
            new[node] = to
            moved += len(node)
        if not moved or (now := quality(new)) <= best + 1e-9:
            break
        c, best = new, now
    return c


def _refined(graph: _Graph, c: np.ndarray, k: np.ndarray, m2: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Connected parts of the communities; in a round the lone nodes of one class join parts that none of them is."""
    n = graph.n
    r = np.arange(n, dtype=np.int32)
    for turn in range(CLASSES):
        state = (c, r, k, m2, gamma, np.bincount(r, k, n), np.bincount(r, minlength=n).astype(np.int32))
        node, to = _moves(_asked(graph, state, lambda sent: _joining(sent, n, turn), cls=turn))  # noqa: B023
        r[node] = to
    return r


def _connected(graph: _Graph, c: np.ndarray) -> np.ndarray:
    """For every node the least node that it reaches within its community: least labels of neighbours, and of what those stand under."""
    label = np.arange(graph.n, dtype=np.int32)
    while True:
        node, to = _moves(_asked(graph, (c, label), _lower))
        if not len(node):
            return label
        np.minimum.at(label, label[node], to)  # the root that a node stood under goes below the new one, too
        np.minimum.at(label, node, to)
        while not np.array_equal(up := label[label], label):
            label = up


def partition_by_sweeps(pairs: DataFrame, nodes: DataFrame, refine: bool, few: Callable, settle: Callable) -> DataFrame:
    """``node_id, community`` of ``pairs(a, b, w)`` and ``nodes(node, part, m2, gamma, k)``, with the least node as name.

    Moved and folded by passes until ``few(pairs, nodes)`` says that ``settle(pairs, nodes, refine)`` can do the rest in tasks.
    """
    spark = pairs.sparkSession
    given = nodes.select("node", "part", "m2", "gamma", "k").toArrow()
    given = given.take(pc.sort_indices(given, [("node", "ascending")])).combine_chunks()
    n = given.num_rows
    part = given.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
    m2, gamma, k = (given.column(x).to_numpy() for x in ("m2", "gamma", "k"))
    kind = nodes.schema["node"].dataType.simpleString()
    names = cut(spark.createDataFrame(pa.table({"node": given.column("node"), "i": pa.array(np.arange(n, dtype=np.int32))})).select(F.col("node").cast(kind), F.col("i").cast("int")))
    end = lambda x: F.broadcast(names.withColumnsRenamed({"node": x, "i": f"i{x}"}))
    numbered = pairs.filter("a <> b").join(end("a"), "a").join(end("b"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "w")
    whole = graph = _Graph(numbered, n, pairs.count())
    top, c = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
    live = np.arange(n, dtype=np.int32)
    for _ in range(MAX_LEVELS):
        c = _settled(graph, c, k, m2, gamma)
        by = _refined(graph, c, k, m2, gamma) if refine else c
        groups, to = np.unique(by, return_inverse=True)
        if len(groups) == len(live) or len(np.unique(c)) == len(live):
            break
        to = to.astype(np.int32)
        # Groups are numbered anew; each has the community of its members, named after the least group.
        first = np.unique(to, return_index=True)[1]
        old = c[first]
        names_of = np.unique(old, return_index=True)
        c = names_of[1][np.searchsorted(names_of[0], old)].astype(np.int32)
        part, m2, gamma, k = part[first], m2[first], gamma[first], np.bincount(to, k, len(groups))
        top, live = to[top], np.arange(len(groups), dtype=np.int32)
        sent = spark.sparkContext.broadcast((to,))
        size = len(groups)
        folded = graph.passed(_folded(sent, size), "a int, b int, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
        state = spark.createDataFrame(pa.table({"node": live, "part": part, "m2": m2, "gamma": gamma, "k": k, "c": c})).select(F.col("node").cast("int"), F.col("part").cast("int"), "m2", "gamma", "k", F.col("c").cast("int"))
        state = cut(state)
        folded = cut(folded.join(F.broadcast(state.select(F.col("node").alias("a"), "part")), "a").select("a", "b", "w", "part"))
        if few(folded, state):
            last = settle(folded, state, refine).toArrow()
            c = np.empty(size, np.int32)
            c[last.column("node").to_numpy()] = last.column("c").to_numpy()
            break
        graph = _Graph(folded, size, folded.count())
    label = _connected(whole, c[top])
    found = spark.createDataFrame(pa.table({"i": pa.array(np.arange(n, dtype=np.int32)), "l": pa.array(label.astype(np.int32))}))
    return cut(found.join(names, "i").select(F.col("node").alias("node_id"), "l").join(names.select(F.col("i").alias("l"), F.col("node").alias("community")), "l").select("node_id", "community"))
