"""Exact joins of vectors by cosine: blocks of bounded size, pruned by angles to pivots and by partial products.

Angles between unit vectors obey the triangle inequality: if two vectors are within an angle of each other, then so are
their angles to any third one, the pivot.  Each vector is put with its nearest pivot; the vectors of a pivot are sorted by
their angle to it and cut into blocks of :data:`BLOCK` vectors.  A block knows the range of its angles to every pivot, so two
blocks whose ranges are too far apart never meet.  Within a pair of blocks the product over the leading dimensions and the
lengths of what remains bound the similarity, and only pairs whose bound reaches the threshold are verified in full.
The tables that are joined have a row per block, not per vector, and no group of vectors is ever held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.operators.iterate import cut

#: Vectors of a block and pivots at most; blocks of a stripe of a cell, and of a side of a tile.
BLOCK, PIVOTS, STRIPE, TILE = 2_048, 32, 256, 32
#: Links that a task holds at most before it reduces them to a forest.
LINKS = 1 << 19
#: Products are compared after this much rounding error.
_EPS = 1e-9


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _binary(v: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(v, "<f8")]


def _unit(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Unit vectors in the turned axes, with the nearest pivot and the angle to it.  Vectors of no length or other dimensions are left out."""
    dim = turn.shape[0]
    for batch in batches:
        lists = batch.column(2)
        good = np.array([x is not None and len(x) == dim and None not in x for x in lists.to_pylist()], bool)
        if not good.any():
            continue
        batch = batch.filter(pa.array(good))
        v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        size = np.linalg.norm(v, axis=1)
        some = np.isfinite(size) & (size > 0)
        v = v[some] / size[some, None] @ turn
        angle = np.arccos(np.clip(v @ pivots.T, -1, 1))
        cell = angle.argmin(1)
        batch = batch.filter(pa.array(some))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(angle.min(1)), pa.array(_binary(v), pa.binary()), pa.array(size[some])], names=["id", "label", "cell", "angle", "v", "size"])


def _cut_blocks(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of one label and cell that follow each other, with the ranges of their angles to all pivots."""
    dim, held, key = pivots.shape[1], [], None

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        v = _matrix(whole.column(4), dim)
        angle = np.arccos(np.clip(v @ pivots.T, -1, 1))
        ids = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(0))
        one = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([whole.column(1).slice(0, 1), whole.column(2).slice(0, 1), pa.array([len(whole)]), ids, pa.array([v.tobytes()], pa.binary()), one(whole.column(5).to_numpy()), one(angle.min(0)), one(angle.max(0))], names=["label", "cell", "n", "ids", "v", "sizes", "low", "high"])

    size = 0
    for batch in batches:
        label, cell = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        i = 0
        while i < batch.num_rows:
            j = i
            while j < batch.num_rows and (label[j], cell[j]) == (label[i], cell[i]) and j - i < BLOCK:
                j += 1
            if key != (label[i], cell[i]) or size + j - i > BLOCK:
                if held:
                    yield block(held)
                held, size, key = [], 0, (label[i], cell[i])
            held.append(batch.slice(i, j - i))
            size += j - i
            i = j
    if held:
        yield block(held)


def blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """``block, label, cell, n, ids, v, sizes, low, high`` of ``vectors(id, label, v)``, stored.  Pivots are the vectors with the smallest hashes; axes are turned towards them, so that leading dimensions say most."""
    given = vectors.select("id", "label", F.col("v").cast("array<double>").alias("v"))
    seeds = [x.v for x in given.filter((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull())).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()]
    p = np.array(seeds, float).reshape(-1, dim)
    size = np.linalg.norm(p, axis=1, keepdims=True)
    p = p[size[:, 0] > 0] / size[size[:, 0] > 0]
    p = p if len(p) else np.eye(1, dim)
    turn = np.linalg.svd(p, full_matrices=True)[2].T
    p = p @ turn
    kinds = f"id {_kind(given, 'id')}, label {_kind(given, 'label')}"
    placed = given.mapInArrow(lambda b: _unit(b, p, turn), f"{kinds}, cell int, angle double, v binary, size double")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "cell", "angle", "id"]
    cells = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = cells.mapInArrow(lambda b: _cut_blocks(b, p), f"label {_kind(given, 'label')}, cell int, n bigint, ids array<{_kind(given, 'id')}>, v binary, sizes array<double>, low array<double>, high array<double>")
    return cut(made.withColumn("block", F.monotonically_increasing_id()))


def _between() -> Column:
    """The least angle that the ranges of two blocks leave between their vectors."""
    gaps = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda x, y: F.greatest(x, y))
    return F.greatest(F.lit(0.0), F.array_max(gaps))


def block_pairs(made: DataFrame, least: float) -> DataFrame:
    """``x, y, label, angle`` (``x <= y``) of blocks of one label that may hold two vectors whose cosine is ``least`` or more; ``angle`` is the least one possible.

    Blocks meet by label and cell, in stripes of :data:`STRIPE` blocks, and a block is sent only to cells whose angles its own can reach.
    """
    reach = pi if least <= -1 else acos(min(least, 1.0)) + _EPS
    about = made.select("block", "label", "cell", "low", "high")
    own = lambda c: F.element_at(c, F.col("cell") + 1)
    cells = about.groupBy("label", "cell").agg(F.min(own("low")).alias("from"), F.max(own("high")).alias("to"), F.ceil(F.count("*") / STRIPE).cast("int").alias("stripes"))
    sent = about.select("block", "label", "low", "high").join(cells, "label").filter((own("low") - reach <= F.col("to")) & (own("high") + reach >= F.col("from")))
    sent = sent.select(F.col("block").alias("x"), "label", "cell", "low", "high", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"))
    dealt = about.join(cells.select("label", "cell", "stripes"), ["label", "cell"]).select(F.col("block").alias("y"), "label", "cell", F.col("low").alias("low2"), F.col("high").alias("high2"), F.pmod(F.xxhash64("block"), "stripes").cast("int").alias("stripe"))
    met = sent.join(dealt, ["label", "cell", "stripe"]).filter("x <= y").withColumn("angle", _between())
    return met.filter(F.col("angle") <= reach).select("x", "y", "label", "angle")


def _tiles(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """``label, tx, ty, block, ys, ids, v, sizes``: the blocks of each tile with those that they meet as ``x``, of pairs of blocks ``x, y`` (``x <= y``) of one label.

    Pairs are dealt to tiles of :data:`TILE` by as many blocks that follow each other, and a block is sent once to each tile
    that needs it, not to each pair.
    """
    count = made.count()
    side = max(1, min(TILE, -(-count // 16)))
    spot = made.select("block", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("block")) - 1) / side).alias("t"))
    dealt = pairs.select("x", "y", "label").join(spot.select(F.col("block").alias("x"), F.col("t").alias("tx")), "x").join(spot.select(F.col("block").alias("y"), F.col("t").alias("ty")), "y")
    none = F.array().cast("array<bigint>")
    need = dealt.select("label", "tx", "ty", F.col("x").alias("block"), F.array("y").alias("ys")).unionByName(dealt.select("label", "tx", "ty", F.col("y").alias("block"), none.alias("ys")))
    need = need.groupBy("label", "tx", "ty", "block").agg(F.sort_array(F.flatten(F.collect_list("ys"))).alias("ys"))
    return need.join(made.select("block", "ids", "v", "sizes"), "block").select("label", "tx", "ty", "block", "ys", "ids", "v", "sizes")


def _met(pairs: DataFrame, made: DataFrame, dim: int, work: Callable, kinds: str) -> DataFrame:
    """What ``work`` makes of every pair of blocks, as rows of ``kinds``.  A task goes through the blocks of a tile from the last to the first and holds them."""
    n = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    tile = ["label", "tx", "ty"]
    rows = _tiles(pairs, made).repartition(n, *tile).sortWithinPartitions(*tile, F.desc("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                at = [str(row.column(i)[0]) for i in range(3)]
                if at != key:
                    held, key = {}, at
                content = row.column(5).flatten(), np.frombuffer(row.column(6)[0].as_buffer(), "<f8").reshape(-1, dim).copy(), row.column(7).flatten().to_numpy()
                held[row.column(3)[0].as_py()] = content
                for y in row.column(4)[0].as_py():
                    yield from work(row.column(0), row.column(3)[0].as_py() == y, content, held[y])

    return rows.mapInArrow(run, kinds)


def _content(row: pa.RecordBatch, side: str, dim: int) -> tuple[pa.Array, np.ndarray]:
    return row.column(f"ids_{side}").flatten(), np.frombuffer(row.column(f"v_{side}")[0].as_buffer(), "<f8").reshape(-1, dim)


def _verified(dim: int, least: float, most: float, open_from: float, dot: bool):
    """``a, b, label, similarity`` of pairs at or above ``least``; a row without ids counts the pairs that were met and verified.  No pair with a cosine below ``open_from`` can be one."""
    head = max(1, dim // 4)

    def run(of: pa.Array, same: bool, one: tuple, two: tuple) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "label", "similarity", "met", "verified"]
        (ids_x, x, sizes_x), (ids_y, y, sizes_y) = one, two
        rest = [np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", m[:, :head], m[:, :head]))) for m in (x, y)]
        met = verified = 0
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            bound = part[:, :head] @ y[:, :head].T + rest[0][i : i + 256, None] * rest[1]
            open_ = bound >= open_from - _EPS
            if same:
                open_ &= np.arange(i, i + len(part))[:, None] < np.arange(len(y))
            met += int((len(y) - 1 - np.arange(i, i + len(part))).sum()) if same else open_.size
            p, q = np.nonzero(open_)
            verified += len(p)
            if 8 * len(p) > open_.size:
                cosine = (part @ y.T)[p, q]
            else:
                cosine = np.einsum("ij,ij->i", part[p], y[q])
            cosine = np.round(cosine * sizes_x[p + i] * sizes_y[q], 15) if dot else np.round(cosine, 12)
            hit = (cosine >= least) & (cosine <= most)
            if hit.any():
                p, q, cosine = p[hit] + i, q[hit], cosine[hit]
                none = pa.nulls(len(p), pa.int64())
                label = pa.array(np.zeros(len(p), np.int64))
                yield pa.RecordBatch.from_arrays([ids_x.take(pa.array(p)), ids_y.take(pa.array(q)), of.take(label), pa.array(cosine), none, none], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, ids_x.type), pa.nulls(1, ids_x.type), of, pa.nulls(1, pa.float64()), pa.array([met]), pa.array([verified])], names=names)

    return run


def _joined(vectors: DataFrame, least: float, dim: int, most: float = 2.0, dot: bool = False) -> DataFrame:
    made = blocks(vectors.filter("label IS NOT NULL"), dim)
    open_from = least
    if dot:
        longest, shortest = made.agg(F.max(F.array_max("sizes")), F.min(F.array_min("sizes"))).first()
        bound = longest if least >= 0 else shortest
        open_from = least / bound**2 if bound else least
    kinds = f"a {_kind(vectors, 'id')}, b {_kind(vectors, 'id')}, label {_kind(vectors, 'label')}"
    return _met(block_pairs(made, open_from), made, dim, _verified(dim, least, most, open_from, dot), f"{kinds}, similarity double, met bigint, verified bigint")


def similar_pairs(vectors: DataFrame, least: float, dim: int, most: float = 2.0, dot: bool = False) -> DataFrame:
    """``a, b, label, similarity`` (``a < b``) of ``vectors(id, label, v)`` with the same label and a cosine from ``least`` to ``most``, rounded to 12 digits.

    Vectors need not have unit length.  Those with no length, another number of components than ``dim``, a null or infinite
    one, and those without a label are like no other.  Rows that repeat an id are no pair with each other.  With ``dot`` the
    similarity is the product of the vectors as given, rounded to 15 digits.
    """
    found = _joined(vectors, least, dim, most, dot).filter("met IS NULL AND a <> b")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label", "similarity")
    # A pair of rows is met once, so only repeated ids give a pair of ids twice.
    repeated = not vectors.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return pairs.dropDuplicates(["a", "b", "label"]) if repeated else pairs


def _under_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least one that the links ``a, b`` connect it with."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _bits(one: pa.Array, two: pa.Array) -> list[np.ndarray]:
    """The sets of strings of both sides as rows of 64-bit words, a bit for each string that occurs."""
    codes = pa.concat_arrays([one.flatten(), two.flatten()]).dictionary_encode()
    at, words = codes.indices.to_numpy(), -(-len(codes.dictionary) // 64)
    found = []
    for sets, place in ((one, at[: len(one.flatten())]), (two, at[len(one.flatten()) :])):
        bits = np.zeros((len(sets), words), np.uint64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy()), place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        found.append(bits)
    return found


def _linked(least: float, overlap: float):
    """``a, b``: each vector of two blocks under the first one that it is linked with, directly or over others of them; ids are structs with the set ``r``."""

    def run(of: pa.Array, same: bool, one: tuple, two: tuple) -> Iterator[pa.RecordBatch]:
        (ids_x, x, _), (ids_y, y, _) = one, two
        bits_x, bits_y = _bits(ids_x.field("r"), ids_y.field("r"))
        size_x, size_y = (np.bitwise_count(b).sum(axis=1, dtype=np.int64) for b in (bits_x, bits_y))
        a, b = [], []
        for i in range(0, len(x), 256):
            cosine = x[i : i + 256] @ y.T
            open_ = cosine >= least - _EPS
            if same:
                open_ &= np.arange(i, i + len(cosine))[:, None] < np.arange(len(y))
            p, q = np.nonzero(open_)
            hit = np.round(cosine[p, q], 12) >= least
            p, q = p[hit] + i, q[hit]
            both = np.zeros(len(p), np.int64)
            for w in range(bits_x.shape[1]):
                both += np.bitwise_count(bits_x[p, w] & bits_y[q, w])
            every = size_x[p] + size_y[q] - both
            alike = np.where(every == 0, 1.0, both / np.maximum(every, 1)) >= overlap
            a.append(p[alike])
            b.append(q[alike] + (0 if same else len(x)))
        a, b = np.concatenate(a), np.concatenate(b)
        ids = ids_x.field("id") if same else pa.concat_arrays([ids_x.field("id"), ids_y.field("id")])
        root = _under_roots(a, b, len(ids))
        under = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(under)), ids.take(pa.array(root[under]))], names=["a", "b"])

    return run


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links ``a, b`` of a task, as few as connect the same; at most :data:`LINKS` and a batch are held."""

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([x.column(i) for i in (0, 1) for x in held]).dictionary_encode()
        root = _under_roots(*np.split(ids.indices.to_numpy(), 2), len(ids.dictionary))
        under = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(under)), ids.dictionary.take(pa.array(root[under]))], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > LINKS:
            held = [forest(held)]
            size = held[0].num_rows
            if 2 * size > LINKS:
                yield held[0]
                held, size = [], 0
    if size:
        yield forest(held)


def links(vectors: DataFrame, least: float, overlap: float, dim: int) -> DataFrame:
    """``a, b``: links that connect what the pairs of ``vectors(id, label, v, r)`` with one label, a cosine of ``least`` or more and a Jaccard index of the sets ``r`` of ``overlap`` or more connect.

    The sets go with the vectors into their blocks, and a task keeps a forest, so no more than a link per vector and task is
    shuffled, however many pairs there are.  Two empty sets are alike.
    """
    made = blocks(vectors.filter("label IS NOT NULL").select(F.struct("id", F.coalesce("r", F.array().cast("array<string>")).alias("r")).alias("id"), "label", "v"), dim)
    kind = _kind(vectors, "id")
    return _met(block_pairs(made, least), made, dim, _linked(least, overlap), f"a {kind}, b {kind}").mapInArrow(_forests, f"a {kind}, b {kind}")


def join_report(vectors: DataFrame, least: float, dim: int) -> DataFrame:
    """One row: ``vectors`` that can match, ``pairs`` of one label among them, ``met`` in blocks that could not be ruled out, ``verified`` in full, ``found``."""
    made = _joined(vectors, least, dim)
    sizes = vectors.filter(F.col("label").isNotNull() & (F.size("v") == dim)).groupBy("label").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
    counts = made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "verified")), F.count("similarity").alias("found"))
    return whole.join(F.broadcast(counts), F.lit(True))


def _best(dim: int, k: int, later: bool):
    """Per vector the ``k`` most similar ones of the other block: ``a, b, label, similarity``."""

    def run(of: pa.Array, same: bool, one: tuple, two: tuple) -> Iterator[pa.RecordBatch]:
        sides = [one[:2], two[:2]]
        turns = [sides] if same else [sides, sides[::-1]]
        for (ids, x), (others, y) in turns:
            order = others.to_pandas().argsort(kind="stable").to_numpy()
            others, y = others.take(pa.array(order)), y[order]
            own, far = ids.to_pandas().to_numpy(), others.to_pandas().to_numpy()
            for i in range(0, len(x), 256):
                cosine = np.round(x[i : i + 256] @ y.T, 12)
                mine = own[i : i + 256, None]
                cosine[~(far > mine if later else far != mine)] = -np.inf
                for _ in range(min(k, len(y))):
                    best = cosine.argmax(1)
                    value = cosine[np.arange(len(best)), best]
                    hit = np.flatnonzero(value > -np.inf)
                    if not len(hit):
                        break
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit + i)), others.take(pa.array(best[hit])), of.take(pa.array(np.zeros(len(hit), np.int64))), pa.array(value[hit])], names=["a", "b", "label", "similarity"])
                    cosine[np.arange(len(best)), best] = -np.inf

    return run


def top_partners(vectors: DataFrame, k: int, dim: int, later: bool = True) -> DataFrame:
    """``a, b, label, similarity, k``: for each vector the ``k`` most similar ones of its label (``later``: with a larger id), of equal ones those with the smaller id.

    First every block meets itself, which bounds from below what its vectors will have found in the end; then it meets the
    blocks whose angles leave room for more.  A task keeps ``k`` rows per vector and pair of blocks.
    """
    made = blocks(vectors.filter("label IS NOT NULL"), dim)
    kinds = f"a {_kind(vectors, 'id')}, b {_kind(vectors, 'id')}, label {_kind(vectors, 'label')}, similarity double"
    best = lambda pairs: _met(pairs, made, dim, _best(dim, k, later), kinds)
    first = cut(best(made.select(F.col("block").alias("x"), F.col("block").alias("y"), "label")))
    kth = first.groupBy("a", "label").agg(F.count("*").alias("n"), F.min("similarity").alias("s"))
    member = made.select("block", "label", F.explode("ids").alias("a"))
    bar = member.join(kth, ["a", "label"], "left").groupBy("block").agg(F.min(F.when(F.col("n") >= k, F.col("s")).otherwise(-1.0)).alias("bar"))
    pairs = block_pairs(made, -1.0).filter("x <> y")
    for side in "xy":
        pairs = pairs.join(bar.withColumnsRenamed({"block": side, "bar": f"bar_{side}"}), side)
    open_ = pairs.filter(F.cos("angle") >= F.least("bar_x", "bar_y") - _EPS).select("x", "y", "label")
    ranked = Window.partitionBy("a", "label").orderBy(F.desc("similarity"), "b")
    every = first.unionByName(best(open_)).distinct()
    return every.withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= k)


def _searched(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of each query over the task's blocks; queries and rows meet only where some dimension is set in both."""
    held: dict[int, tuple] = {}

    def out(q: int) -> Iterator[pa.RecordBatch]:
        queries, ids, score = held.pop(q)
        row, place = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([queries.take(pa.array(row)), pa.array(ids[row, place], id_type), pa.array(score[row, place])], names=["query_id", "doc_id", "score"])

    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            (ids, x), (queries, y) = (_content(row, s, dim) for s in "xy")
            q, id_type = row.column("y")[0].as_py(), ids.type
            order = ids.to_pandas().argsort(kind="stable").to_numpy()
            own, x = ids.to_pandas().to_numpy()[order], x[order]
            score = np.maximum(0.0, np.round(y @ x.T, 6))
            score[(y != 0).astype(float) @ (x != 0).T.astype(float) == 0] = -np.inf
            if q in held:
                _, ids_before, before = held[q]
                score, all_ids = np.hstack([before, score]), np.hstack([ids_before, np.broadcast_to(own, score.shape)])
            else:
                all_ids = np.broadcast_to(own, score.shape)
            top = np.lexsort((all_ids, -score), axis=1)[:, :k] if len(own) else np.zeros((len(y), 0), int)
            held[q] = queries, np.take_along_axis(all_ids, top, 1), np.take_along_axis(score, top, 1)
            if len(held) > 64:
                yield from out(next(iter(held)))
    for q in list(held):
        yield from out(q)


def _packed(dense: DataFrame, name: str, size: int, dim: int) -> DataFrame:
    """Rows ``<name>, ids_<name>, v_<name>`` of at most ``size`` sparse vectors ``id, slots, xs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                v = np.zeros((part.num_rows, dim))
                n = np.diff(part.column(1).offsets.to_numpy())
                v[np.repeat(np.arange(part.num_rows), n), part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes()], pa.binary())], names=[f"ids_{name}", f"v_{name}"])

    made = dense.select("id", "slots", "xs").mapInArrow(run, f"ids_{name} array<{_kind(dense, 'id')}>, v_{name} binary")
    return made.withColumn(name, F.monotonically_increasing_id())


def search_blocks(docs: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """``query_id, doc_id, score, rank``: for each query the ``k`` documents of highest product, negative ones as 0, of those that share a dimension with it.

    Both are sparse vectors ``id, slots, xs``.  Blocks of documents are scored against blocks of queries, and a task keeps
    ``k`` documents per query, so what is shuffled does not grow with the documents of a task.
    """
    x, y = cut(_packed(docs, "x", BLOCK, dim)), cut(_packed(queries, "y", 512, dim))
    met = x.crossJoin(y)  # rows are blocks: the given queries against all documents
    kinds = f"query_id {_kind(queries, 'id')}, doc_id {_kind(docs, 'id')}, score double"
    found = met.mapInArrow(lambda b: _searched(b, dim, k), kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
