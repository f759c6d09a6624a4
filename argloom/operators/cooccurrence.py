"""Pairs that share groups, counted where they are made.

The pairs of a group are the square of its members, so they are neither shuffled nor stored.  Members are cut into ranges that make
about :data:`BLOCK_PAIRS` pairs each; a group's sorted members are sent once to each range that holds some of them, from the first
of those on.  The task of a range goes through its members in order, makes the pairs of some at a time and counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.operators.iterate import TASK_ROWS, cut, freed

#: Pairs of a range of members on average, pairs that a task makes at a time, and members that it sends at a time.
BLOCK_PAIRS, MADE, SENT = 1 << 23, 1 << 20, 1 << 18


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges ``starts[i] .. starts[i] + counts[i] - 1``, one after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where another value begins in sorted ``x``."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, own, members``: per group and range the members from there on, of which the first ``own`` are of the range."""
    parts = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches if batch.num_rows]
    if not parts:
        return
    p, a, block = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((a, p))
    p, a, block = p[order], a[order], block[order]
    group = np.cumsum(np.concatenate([[0], p[1:] != p[:-1]]))
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (block[1:] != block[:-1])]))
    own = np.diff(np.append(first, len(p)))
    count = np.append(_starts(group)[1:], len(p))[group[first]] - first
    first, own, count = (x[count > 1] for x in (first, own, count))
    upto, i = np.concatenate([[0], np.cumsum(count)]), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + SENT, side="right")) - 1)
        members = pa.ListArray.from_arrays(pa.array(upto[i : j + 1] - upto[i], pa.int32()), pa.array(a[_ranges(first[i:j], count[i:j])]))
        yield pa.RecordBatch.from_arrays([pa.array(block[first[i:j]]), pa.array(own[i:j]), members], names=["block", "own", "members"])
        i = j


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, n_shared`` of the pairs whose smaller member is of the task's range."""
    held = [(batch.column(1).to_numpy(), batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten().to_numpy()) for batch in batches if batch.num_rows]
    if not held:
        return
    own, count, flat = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    ids, flat = np.unique(flat, return_inverse=True)
    wide = len(ids)
    at = _ranges(np.cumsum(count) - count, own)
    more = np.repeat(np.cumsum(count), own) - at - 1  # members of the group after this one
    order = np.argsort(flat[at], kind="stable")
    at, more = at[order], more[order]
    member, upto = flat[at], np.concatenate([[0], np.cumsum(more)])
    left, i = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + MADE, side="right")) - 1)
        key = np.repeat(member[i:j] * wide, more[i:j]) + flat[_ranges(at[i:j] + 1, more[i:j])]
        key.sort()
        first = _starts(key)
        key, n = key[first], np.diff(np.append(first, len(key)))
        if len(left[0]):
            key, n = np.concatenate([left[0], key]), np.concatenate([left[1], n])
            order = np.argsort(key, kind="stable")
            first = _starts(key[order])
            key, n = key[order][first], np.add.reduceat(n[order], first)
        # A member whose groups go on in the next turn waits for it.
        whole = int(np.searchsorted(key, member[j - 1] * wide)) if j < len(at) and member[j] == member[j - 1] else len(key)
        left = key[whole:], n[whole:]
        for x in range(0, whole, SENT):
            of = key[x : min(x + SENT, whole)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[of // wide]), pa.array(ids[of % wide]), pa.array(n[x : x + len(of)])], names=["a", "b", "n_shared"])
        i = j


def shared_groups(members: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``a, b, n_shared`` (``a < b``) of ``members(a, p)``, 64-bit ids: the pairs that have a ``p`` in common, with how many they have."""
    m = cut(members.filter("a IS NOT NULL AND p IS NOT NULL").select(F.col("a").cast("bigint").alias("a"), F.col("p").cast("bigint").alias("p")).distinct())
    freed(m.sparkSession)
    sizes = m.groupBy("p").agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)))
    rows, pairs = sizes.first()
    blocks = max(1, int(-(-pairs // BLOCK_PAIRS)), int(-(-rows // task_rows)))
    m = cut(m.repartitionByRange(blocks, "a").select("p", "a", F.spark_partition_id().alias("block")))
    freed(m.sparkSession)
    lists = m.repartition(max(1, int(-(-rows // task_rows))), "p").mapInArrow(_sent, "block int, own bigint, members array<bigint>")
    return lists.repartitionById(blocks, "block").mapInArrow(_made, "a bigint, b bigint, n_shared bigint")
