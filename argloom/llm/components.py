"""Connected components of a link table: forests within tasks, then rounds of merging and jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import cut

MAX_ROUNDS = 60
#: Links that a task holds at a time.
_HELD = 1 << 20
_LINK = "a bigint, b bigint, many boolean"


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node under the least node it is connected with here; ``many`` marks a node that had several smaller neighbours."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    child, parent = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    np.minimum.at(root, child, parent)
    several = np.zeros(len(names), bool)
    order = np.lexsort((parent, child))
    again = (child[order][1:] == child[order][:-1]) & (parent[order][1:] != parent[order][:-1])
    several[child[order][1:][again]] = True
    while True:  # hook the roots of each link's ends, then halve paths, until no link is left between trees
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[child], root[parent]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
    under = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[under]), pa.array(names[root[under]]), pa.array(several[under])], names=["a", "b", "many"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the links in a task; of links in order, those of one larger end meet in one forest."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= _HELD:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            yield _forest(a, b)
            # The last larger end may go on: its least smaller end stands for what was seen of it.
            held, size = [(a[-1:], b[a == a[-1]].min(keepdims=True))], 1
    if size:
        yield _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))


def connected_components(links: DataFrame) -> DataFrame:
    """From ``a, b`` (64-bit ids): ``node, component`` for every linked node; ``component`` is its component's least id.

    Links are first reduced to forests within tasks.  A round then brings the links of each larger end
    together, merges them into forests, and lets every node jump to the least parent of its parent.  Nothing
    gathers the nodes below a hub: they are keyed by themselves, and in the jump they are the large side of a join whose
    hot keys adaptive execution splits.  Each round is cut by a checkpoint; the number of rounds grows with the
    logarithm of the longest path.  Null ids and self links are left out.
    """
    given = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = given.mapInArrow(_forests, _LINK)
    for _ in range(MAX_ROUNDS):
        merged = cut(edges.select("a", "b").repartition("a").sortWithinPartitions("a").mapInArrow(_forests, _LINK))
        parent = merged.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("next"))
        edges = cut(merged.join(parent, "b", "left").select("a", F.coalesce("next", "b").alias("b"), (F.col("many") | F.col("next").isNotNull()).alias("many")))
        if edges.filter("many").isEmpty():
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
