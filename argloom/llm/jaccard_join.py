"""Exact set-similarity join of documents on word n-grams, with set-relation skipping.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
distinct n-grams.

1. Every set gets a 128-bit digest; equal sets are one class, so copies never form pairs.
   The same pass counts what is frequent within tasks; only the order of members follows
   from these counts, and the join is exact under any order.
2. Every set puts forward its prefix: its rarest members, half as many again as a linked set can lack.  Sets that
   link have the other half of them in common.  The (member, size, set) rows are sorted over all tasks, and a
   stream through each partition cuts them into runs: sets of one member whose sizes follow each other
   within the ratio of a link.  Sets that are not alone in too few of their runs have no link.  A
   member in a third of all sets is a long run of that stream, never a group in memory.
3. A set's home is the set that is first in most of its runs, so near copies have mostly one home.  Homes are dealt into blocks of bounded size, a large home into several.  A set is sent to its
   own block, and to the pairs of its block with just those others that share one of its rarer runs: what all blocks hold is seldom among these.
4. Within a pair of blocks, inverted lists hold (position, set), sorted by position; a probe skips
   the blocks of a list whose positions cannot reach the required overlap any more, and
   verifies its candidates alone.  If the set before was highly similar, no list of a common member is
   read again: the overlaps that were worked out for that set, plus the lists of the new members,
   less those of the missing ones, are the answer.

Defined results: a null text or one without words has the empty set, which links with
nothing; with fewer than n words the whole sequence is the one member; repeated rows and
copies are one class and link with each other; rows that repeat an id with another text are
documents of their own, linked by their texts and not by the id; a null id takes part with no id of
its own in the result; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import broadcast_if_small, cut, in_batches
from argloom.llm._words import Chunk, chunks, mix, ranges, window_hashes
from argloom.llm.components import connected_components

#: Members that a task counts at a time, and the count from which one is passed on.
_FLUSH = 1 << 20
_OFTEN = 4
#: Members whose frequency is broadcast at most: 16 bytes each.
HEAVY = 1 << 18
_HEAVY_FROM = 16
#: Set members that a block has on average.
_BLOCK = 400_000
#: Sets that are joined to their texts by broadcast at most: about 100 bytes each.
_FEW_SETS = 200_000
_FEW_IDS = 1_000_000
_SKIP = 64
#: Candidates up to which a set is verified against each, rather than counted against all.
_EACH = 24


def doc_sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one text after the other, and where each text's start (one more entry at the end)."""
    words = chunk.word_hashes()
    h, at = chunk.shingles(k, words)
    count = np.diff(chunk.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        parts, extra = [], np.zeros(len(chunk), np.int64)
        extra[short] = 1
        whole = {int(i): window_hashes(words[chunk.first[i] : chunk.first[i + 1]], int(count[i])) for i in short}
        for i in range(len(chunk)):
            parts.append(whole[i] if i in whole else h[at[i] : at[i + 1]])
        h = np.concatenate(parts)
        at = np.concatenate([[0], np.cumsum(np.diff(at) + extra)])
    for i in range(len(chunk)):
        h[at[i] : at[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[at[:-1][at[:-1] < len(h)]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def set_digests(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's members; zero for the empty set."""
    out = []
    full = np.flatnonzero(np.diff(at))
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        d = np.zeros(len(at) - 1, np.uint64)
        if len(full):
            d[full] = np.add.reduceat(mix(h ^ np.uint64(salt)), at[full])
        out.append(d.view(np.int64))
    return out[0], out[1]


def _misses(n: np.ndarray, percent: int) -> np.ndarray:
    """Members of a set that a linked set can lack at most."""
    return n - -(-n * percent // 100)


def _common(n: np.ndarray, percent: int) -> np.ndarray:
    """Members by which a set's prefix is longer than what a linked set can lack: so many are in the prefixes of both, or as many as the smaller set's."""
    return _misses(n, percent) // 2 + 1


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """From rows whose last column is the text: parts of the batch with their sets."""
    for batch in batches:
        for chunk in chunks(batch.column(batch.num_columns - 1), lower=True):
            yield (batch.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start), *doc_sets(chunk, k))


def _fresh(d1: np.ndarray, d2: np.ndarray, n: np.ndarray, seen: set[tuple[int, int]]) -> np.ndarray:
    """Sets with members that a task has not met since ``seen`` was cleared."""
    return np.array([not (key in seen or seen.add(key)) for key in zip(d1.tolist(), d2.tolist(), strict=True)], bool) & (n > 0)


def _digested(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, d1, d2`` of each document; beside them ``member, n`` of what is frequent within a task."""
    names = ["doc_id", "n", "d1", "d2", "member"]

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        m, c = np.unique(np.concatenate(held), return_counts=True)
        m, c = m[c >= _OFTEN].view(np.int64), c[c >= _OFTEN].astype(np.int64)
        none = pa.nulls(len(m), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(c), none, none, pa.array(m)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0
        for rows, h, at in _sets(batches, k):
            n = np.diff(at)
            d1, d2 = set_digests(h, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(d1), pa.array(d2), pa.nulls(len(n), pa.int64())], names=names)
            held.append(h[np.repeat(_fresh(d1, d2, n, seen), n)])
            size += len(held[-1])
            if size >= _FLUSH:
                yield often(held)
                held, size = [], 0
                seen.clear()
        if held:
            yield often(held)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, member bigint")


def _heavy_members(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent members, sorted, and their counts: at most ``HEAVY``, by a cut on the count."""
    counts = cut(counted.groupBy("member").agg(F.sum("n").alias("c")).filter(F.col("c") >= _HEAVY_FROM).withColumn("level", F.floor(F.log2("c") * 4).cast("int")))
    total, least = 0, None
    for row in counts.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += row["n"]
        if total > HEAVY:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.filter(F.col("level") >= least).select("member", "c").toPandas().sort_values("member")
    return top["member"].to_numpy(np.int64), top["c"].to_numpy(np.int64)


def _prefix(h: np.ndarray, at: np.ndarray, heavy: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest members of each set (those that are not heavy first, by hash), and the set of each."""
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    c = np.zeros(len(h), np.int64)
    if len(heavy):
        m = h.view(np.int64)
        spot = np.minimum(np.searchsorted(heavy, m), len(heavy) - 1)
        c = np.where(heavy[spot] == m, counts[spot], 0)
    order = np.lexsort((c, own))  # stable, and members are in order of their hash
    first = np.arange(len(h)) - at[own] < (_misses(n, percent) + _common(n, percent))[own]
    return h[order[first]], own[first]


def _prefixes(docs: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """``member, n, d1``: each set's prefix and size, once per task and flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, counts = heavy.value
        seen: set[tuple[int, int]] = set()
        for _, h, at in _sets(batches, k):
            n = np.diff(at)
            d1, d2 = set_digests(h, at)
            m, own = _prefix(h, at, members, counts, percent)
            fresh = _fresh(d1, d2, n, seen)[own]
            own = own[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(m[fresh].view(np.int64)), pa.array(n[own], pa.int32()), pa.array(d1[own])], names=["member", "n", "d1"])
            if len(seen) > 50_000:
                seen.clear()

    return docs.select("text").mapInArrow(run, "member bigint, n int, d1 bigint")


def _runs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From ``member, n, d1`` in order: ``d1, run, rep`` for the rows of runs with several sets.

    A run is a member's sets whose sizes follow each other within the ratio of a link, so sets that link and share a
    prefix member share a run.  ``rep`` is the run's first set.
    """
    rep, done, last = None, False, None  # the run that may go on: its first row, whether that was passed on, and its last row
    for batch in batches:
        m, n, d = (batch.column(c).to_numpy() for c in range(3))
        one = np.ones(len(m), bool)
        one[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
        if last is not None:
            one[: int(np.argmin(np.append((m == last[0]) & (d == last[2]), False)))] = False
        m, n, d = m[one], n[one].astype(np.int64), d[one]
        if not len(m):
            continue
        before = last or (~m[0], 0, 0)
        start = (m != np.append(before[0], m[:-1])) | (percent * n > 100 * np.append(before[1], n[:-1]))
        last = m[-1], n[-1], d[-1]
        if not start[0]:  # the run goes on: put its first row before the others
            m, d, start = np.append(rep[0], m), np.append(rep[1], d), np.append(True, start)
        else:
            done = False
        starts = np.flatnonzero(start)
        size = np.diff(np.append(starts, len(m)))
        many = np.repeat(size > 1, size)
        if done:
            many[0] = False
        first = np.repeat(d[starts], size)[many]
        yield pa.RecordBatch.from_arrays([pa.array(d[many]), pa.array(mix(mix(m[many].view(np.uint64)) + first.view(np.uint64)).view(np.int64)), pa.array(first)], names=["d1", "run", "rep"])
        done = bool(size[-1] > 1 or (done and len(starts) == 1))
        rep = m[starts[-1]], d[starts[-1]]


class BlockJoin:
    """The links between two lists of sets, or within one (``right`` is None)."""

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray] | None, percent: int):
        self.percent = percent
        every = left + (right or [])
        self.n = np.array([len(s) for s in every], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        flat = np.concatenate(every)
        _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        own = np.repeat(np.arange(len(every)), self.n)
        order = np.lexsort((rank[ids], own))
        self.token = rank[ids][order]  # rarest first within each set
        self.first_right = len(left) if right is not None else 0
        pos = np.arange(len(flat)) - self.at[own]
        listed = own >= self.first_right
        by = np.lexsort((pos[listed], self.token[listed]))
        self.list_set, self.list_pos = own[listed][by], pos[listed][by]
        self.list_at = np.searchsorted(self.token[listed][by], np.arange(len(df) + 1))
        self.count = len(every)
        self.probes = range(len(left))

    def tokens(self, x: int) -> np.ndarray:
        return self.token[self.at[x] : self.at[x + 1]]

    def _counts(self, tokens: np.ndarray) -> np.ndarray:
        starts = self.list_at[tokens]
        return np.bincount(self.list_set[ranges(starts, self.list_at[tokens + 1] - starts)], minlength=self.count)

    def _candidates(self, x: int) -> np.ndarray:
        """Sets that share a prefix member with ``x`` at positions from which the required overlap can be reached."""
        n = int(self.n[x])
        least = -(-n * self.percent // 100)
        prefix = self.tokens(x)[: n - least + 1]
        starts, ends = self.list_at[prefix], self.list_at[prefix + 1]
        # A linked set has at most n * 100 / percent members, so its position is below that less the required overlap.
        furthest = n * 100 // self.percent - least
        blocks = np.maximum(ends - starts, 0) // _SKIP
        for i in np.flatnonzero(blocks > 1):
            heads = self.list_pos[starts[i] : ends[i] : _SKIP]
            ends[i] = min(ends[i], starts[i] + _SKIP * int(np.searchsorted(heads, furthest, side="right")))
        at = ranges(starts, ends - starts)
        y, i, j = self.list_set[at], np.repeat(np.arange(len(prefix)), ends - starts), self.list_pos[at]
        need = -(-self.percent * (n + self.n[y]) // (100 + self.percent))
        return np.unique(y[1 + np.minimum(n - i - 1, self.n[y] - j - 1) >= need])

    def _linked(self, x: int, y: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        after = y > x if self.first_right == 0 else np.ones(len(y), bool)
        return y[after & (100 * overlap >= self.percent * (self.n[x] + self.n[y] - overlap)) & (overlap > 0)]

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """Per probing set its linked sets, as indices over left, then right."""
        order = sorted((x for x in self.probes if self.n[x]), key=lambda x: (int(self.token[self.at[x + 1] - 1]), int(self.n[x])))
        told, answer = None, None  # a set and its overlaps with all others
        for x in order:
            tokens = self.tokens(x)
            if told is not None and 4 * abs(len(tokens) - len(told)) < len(tokens):
                new, gone = np.setdiff1d(tokens, told, assume_unique=True), np.setdiff1d(told, tokens, assume_unique=True)
                if 2 * (len(new) + len(gone)) < len(tokens):
                    answer, told = answer + self._counts(new) - self._counts(gone), tokens
                    y = np.flatnonzero(answer)
                    yield x, self._linked(x, y, answer[y])
                    continue
            found = self._candidates(x)
            found = found[found > x] if self.first_right == 0 else found
            if len(found) > _EACH:
                answer, told = self._counts(tokens), tokens
                yield x, self._linked(x, found, answer[found])
            elif len(found):
                overlap = np.array([np.isin(tokens, self.tokens(y), assume_unique=True).sum() for y in found.tolist()], np.int64)
                yield x, self._linked(x, found, overlap)


_FOUND = "a bigint, b bigint, links bigint"


def _join_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Rows ``a, b, links``: links of class ``a`` counted in documents, and links ``(a, b)`` that span what is connected here."""
    _, one = np.unique(np.stack([table.column("side").to_numpy(), table.column("node").to_numpy()]), axis=1, return_index=True)
    table = table.take(np.sort(one))
    side, node, copies = table.column("side").to_numpy(), table.column("node").to_numpy(), table.column("copies").to_numpy()
    sets = [m.values.to_numpy() for m in table.column("members").combine_chunks()]
    order = np.argsort(side, kind="stable")
    within = table.column("within")[0].as_py()
    left = [sets[i] for i in np.flatnonzero(side == 0)]
    right = None if within else [sets[i] for i in np.flatnonzero(side == 1)]
    if not left or (not within and not right):
        return pa.table({c: np.zeros(0, np.int64) for c in ("a", "b", "links")})
    node, copies = node[order], copies[order]
    total = np.zeros(len(node), np.int64)
    root = list(range(len(node)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    spanning = []
    for x, linked in BlockJoin(left, right, percent).links():
        total[x] += copies[linked].sum()
        total[linked] += copies[x]
        for y in linked.tolist():
            i, j = find(x), find(y)
            if i != j:
                root[i] = j
                spanning.append((x, y))
    some = np.flatnonzero(total)
    a, b = (np.array(spanning, np.int64).reshape(-1, 2).T) if spanning else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.table({"a": np.concatenate([node[some], node[a]]), "b": pa.array([None] * len(some) + node[b].tolist(), pa.int64()), "links": np.concatenate([total[some], np.zeros(len(a), np.int64)])})


def _least_common(percent: int) -> Column:
    """Runs that a set of ``n`` members has in common with a linked set at least: ``_common`` of the smallest such set."""
    smallest = F.ceil(F.col("n") * percent / 100)
    return F.floor((smallest - F.ceil(smallest * percent / 100)) / 2) + 1


def _placed(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` with ``block``, and ``others``: the blocks that hold sets with one of its rarer runs among theirs."""
    whole = sets.agg(F.sum("n")).first()[0] or 0
    large = cut(sets.groupBy("home").agg(F.sum("n").alias("size")).filter(F.col("size") > _BLOCK).select("home", F.ceil(F.col("size") / _BLOCK).alias("parts")))
    small = F.xxhash64(F.pmod(F.xxhash64("home"), F.lit(1 + whole // _BLOCK)))
    block = F.when(F.col("parts").isNull(), small).otherwise(F.xxhash64("home", F.pmod("d1", F.col("parts"))))
    sets = cut(sets.join(broadcast_if_small(large), "home", "left").withColumn("block", block).drop("parts", "home"))
    # Linked sets have enough runs in common that one is in both sets' rarer parts: all runs but the most common ones, one fewer than they share.
    put = sets.select("node", F.explode("runs").alias("run"))
    often = put.groupBy("run").agg(F.count("*").alias("c"))
    ranked = put.join(often, "run").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "run"))).alias("ranked"))
    rarer = F.slice("ranked", F.lit(1), (F.size("ranked") - _least_common(percent) + 1).cast("int"))
    rare = cut(sets.select("node", "block", "n").join(ranked, "node").select("node", "block", F.explode(rarer.getField("run")).alias("run")))
    across = rare.groupBy("run").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo < hi").select("run")
    shared = cut(rare.join(across, "run"))
    lists = shared.select("run", F.col("block").alias("other")).distinct()
    others = shared.join(lists, "run").filter("block <> other").groupBy("node").agg(F.collect_set("other").alias("others"))
    return sets.drop("runs").join(others, "node", "left")


def _block_links(docs: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Reads the texts of the placed sets again and joins each pair of blocks."""
    placed = placed.withColumnRenamed("cls", "doc_id")
    texts = docs.join(broadcast_if_small(placed, _FEW_SETS), "doc_id").select("node", "d1", "d2", "copies", "block", "others", "text")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, at in _sets(batches, k):
            d1, d2 = set_digests(h, at)
            # A row that shares the id of a class, but not its set, is not the one that was asked for.
            mine = np.flatnonzero((d1 == rows.column(1).to_numpy()) & (d2 == rows.column(2).to_numpy()))
            node, copies, block = (rows.column(c).to_numpy() for c in (0, 3, 4))
            others = rows.column(5).to_pylist()
            out = []
            for i in mine.tolist():
                own = int(block[i])
                for other in [own, *(others[i] or [])]:
                    out.append((min(own, other), max(own, other), int(own > other), own == other, node[i], copies[i], h[at[i] : at[i + 1]].view(np.int64)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["lo", "hi", "side", "within", "node", "copies", "members"])

    dealt = texts.mapInArrow(deal, "lo bigint, hi bigint, side int, within boolean, node bigint, copies bigint, members array<bigint>")
    return dealt.groupBy("lo", "hi").applyInArrow(lambda table: _join_blocks(table, percent), _FOUND)


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, class_id, component_id, n_links``.

    ``class_id`` is the least id with the same set, ``component_id`` the least id reachable by links, ``n_links`` the number of other documents that the document links with.
    """
    sc = docs.sparkSession.sparkContext
    given = in_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    told = cut(_digested(given, k))
    rows = told.filter("member IS NULL").select("doc_id", "n", "d1", "d2")
    heavy = sc.broadcast(_heavy_members(told.filter("member IS NOT NULL").select("member", "n")))
    classes = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("cls"), F.first("n").alias("n"), F.count("*").alias("copies"))
    # Ids of classes are drawn from the written rows, so that they stay as they are when a task runs again.
    classes = cut(classes.filter("cls IS NOT NULL")).withColumn("node", F.monotonically_increasing_id())

    by_member = _prefixes(given, k, percent, heavy).repartition("member").sortWithinPartitions("member", "n", "d1")
    shared = by_member.mapInArrow(lambda batches: _runs(batches, percent), "d1 bigint, run bigint, rep bigint")
    sets = cut(shared.groupBy("d1").agg(F.mode("rep", True).alias("home"), F.collect_list("run").alias("runs")).join(classes, "d1").filter(F.size("runs") >= _least_common(percent)))
    heavy.unpersist()
    found = cut(_block_links(given, cut(_placed(sets, percent)), k, percent))

    parts = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    linked = cut(parts.join(classes.select("node", "cls"), "node"))
    least = linked.groupBy("component").agg(F.min("cls").alias("component_id"))
    named = linked.join(least, "component").select("node", "component_id")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    every = classes.join(named.join(counts, "node"), "node", "left")
    every = every.select("d1", "d2", "cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return rows.join(every, ["d1", "d2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("cls", "doc_id").alias("class_id"),
        F.coalesce("component_id", "cls", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the one with the least id) of each component; all columns stay as they are.

    Rows that repeat an id are one document here: they go if one of their texts has a partner with a smaller id.
    """
    gone = cut(jaccard_classes(docs, k, percent, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("_argloom_gone")))
    gone = broadcast_if_small(gone, _FEW_IDS)
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_argloom_gone"], "left_anti")
