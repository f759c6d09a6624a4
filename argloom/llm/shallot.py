"""Centroid clustering by exact rounds of assignment and averaging, with Shallot search.

Each vector carries its nearest and its second-nearest centroid, an upper bound on the distance to the first and a lower
bound on the distance to all others.  A round moves the bounds by how far the centroids moved.  While the upper one is
below the lower one, or below half the way to the centroid's nearest neighbour, the vector keeps its centroid and nothing
is computed.  Otherwise both remembered centroids are measured, and from the closer one the other centroids are visited in
the order of their distance from it: by the triangle inequality none outside the ball of radius (distance to the closer one
+ distance to the second best so far) can be nearest or second-nearest, and that ball shrinks as the search goes on.
Distances are compared as integers, so ties are decided exactly; floating-point bounds are rounded to the safe side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import shared_path

#: Centroids at most: all tasks hold them and their distances from each other.
MAX_CENTROIDS = 4_096
_FAR = np.iinfo(np.int64).max
#: Relative room for the rounding of floating-point bounds.
_ROOM = 1e-9
_STATE = "vec_id bigint, v binary, a int, b int, u double, l double, n bigint, sums array<bigint>"
_FINAL = "vec_id bigint, a int, distance bigint, n bigint, total bigint"


def largest(dim: int) -> int:
    """The largest absolute component whose squared distances surely fit 64 bits."""
    return isqrt((2**63 - 1) // dim) // 2


class Centroids:
    """Integer centroids, the distances between them, and each one's neighbours by distance (itself first)."""

    def __init__(self, at: np.ndarray):
        self.at = at
        self.k = len(at)
        self.apart = np.zeros((self.k, self.k))
        for i in range(self.k):
            self.apart[i] = np.sqrt(squares(at, at[i : i + 1]).astype(float))
        own = self.apart.copy()
        np.fill_diagonal(own, -1.0)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.half = np.full(self.k, np.inf) if self.k == 1 else np.take_along_axis(self.apart, self.order[:, 1:2], 1)[:, 0] / 2 * (1 - _ROOM)

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.at[i].tolist())).encode()).hexdigest()


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows, in integers."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def search(v: np.ndarray, c: Centroids, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second-nearest centroid of each row with squared distances, from two remembered ones (-1: none, for the second).  Of equal distances the smaller number is nearer."""
    d1 = squares(v, c.at[first])
    known = second >= 0
    d2 = np.where(known, squares(v, c.at[second]), _FAR)
    swap = known & ((d2 < d1) | ((d2 == d1) & (second < first)))
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, other, reach = first.copy(), second.copy(), np.sqrt(d1.astype(float))
    active = np.arange(len(v))
    for j in range(1, c.k):
        to = c.order[start[active], j]
        inside = c.apart[start[active], to] <= (reach[active] + np.sqrt(d2[active].astype(float))) * (1 + _ROOM)
        active, to = active[inside], to[inside]
        if not len(active):
            break
        new = to != other[active]
        row, to = active[new], to[new]
        d = squares(v[row], c.at[to])
        wins = (d < d1[row]) | ((d == d1[row]) & (to < first[row]))
        next_ = ~wins & ((d < d2[row]) | ((d == d2[row]) & (to < second[row])))
        w, x = row[wins], row[next_]
        d2[w], second[w] = d1[w], first[w]
        d1[w], first[w] = d[wins], to[wins]
        d2[x], second[x] = d[next_], to[next_]
    return first, second, d1, d2


def _bounds(d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.sqrt(d1.astype(float)) * (1 + _ROOM), np.where(d2 == _FAR, np.inf, np.sqrt(d2.astype(float)) * (1 - _ROOM))


def reassign(v: np.ndarray, c: Centroids, moved: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next round's ``a, b, u, l``, after centroids went ``moved`` far."""
    others = np.full(c.k, moved.max())
    if c.k > 1:
        top = int(moved.argmax())
        others[top] = np.delete(moved, top).max()
    u = (u + moved[a]) * (1 + _ROOM)
    low = low - others[a] * (1 + _ROOM)
    bar = np.maximum(low, c.half[a])
    loose = np.flatnonzero(u >= bar)
    u[loose] = np.sqrt(squares(v[loose], c.at[a[loose]]).astype(float)) * (1 + _ROOM)
    open_ = loose[u[loose] >= bar[loose]]
    if len(open_):
        first, second, d1, d2 = search(v[open_], c, a[open_], b[open_])
        a[open_], b[open_] = first, second
        u[open_], low[open_] = _bounds(d1, d2)
    return a, b, u, low


class _Sums:
    """Counts and component sums by centroid, over a task."""

    def __init__(self, k: int, dim: int):
        self.n = np.zeros(k, np.int64)
        self.sums = np.zeros((k, dim), np.int64)

    def add(self, a: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        which, at, n = np.unique(a[order], return_index=True, return_counts=True)
        if len(which):
            self.n[which] += n
            self.sums[which] += np.add.reduceat(v[order], at, axis=0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        met = np.flatnonzero(self.n)
        if len(met):
            none = lambda kind: pa.nulls(len(met), kind)
            yield _state(none(pa.int64()), none(pa.binary()), met, none(pa.int32()), none(pa.float64()), none(pa.float64()), self.n[met], pa.array(self.sums[met].tolist(), pa.list_(pa.int64())))


def _state(vec_id, v, a, b, u, low, n, sums) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
    columns = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip((vec_id, v, a, b, u, low, n, sums), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "a", "b", "u", "l", "n", "sums"])


def _packed(v: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(v, dtype="<i4")
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.arange(0, data.nbytes + 1, 4 * v.shape[1], dtype=np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<i4", count=len(column) * dim, offset=int(at[0])).reshape(-1, dim).astype(np.int64)


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of rows, refused where squared distances would not fit 64 bits."""
    whole = np.floor(x * scale)
    if len(x) and np.abs(whole).max() > largest(x.shape[1]):
        raise ValueError(f"floor({scale} * x) is beyond {largest(x.shape[1])} for a component: its squared distances do not fit 64 bits")
    return whole.astype(np.int64)


def _first_round(dim: int, scale: int, c: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(c.k, dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = to_integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
            a, b, d1, d2 = search(v, c, np.zeros(len(v), np.int64), np.full(len(v), -1))
            sums.add(a, v)
            yield _state(batch.column(0), _packed(v), a, b, *_bounds(d1, d2), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.list_(pa.int64())))
        yield from sums.rows()

    return run


def _round(dim: int, c: Centroids, moved: np.ndarray, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = _Sums(c.k, dim), [0] * c.k
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch.column(1), dim)
            a, b, u, low = (batch.column(i).to_numpy().copy() for i in range(2, 6))
            a, b, u, low = reassign(v, c, moved, a, b, u, low)
            sums.add(a, v)
            if last:
                d = squares(v, c.at[a])
                for i in np.unique(a).tolist():
                    total[i] += sum(map(int, d[a == i]))
                none = pa.nulls(len(v), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int32()), pa.array(d), none, none], names=["vec_id", "a", "distance", "n", "total"])
            else:
                yield _state(batch.column(0), batch.column(1), a, b, u, low, pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.list_(pa.int64())))
        if last:
            met = np.flatnonzero(sums.n)
            none = pa.nulls(len(met), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(met, pa.int32()), none, pa.array(sums.n[met]), pa.array([total[i] for i in met], pa.int64())], names=["vec_id", "a", "distance", "n", "total"])
        else:
            yield from sums.rows()

    return run


def _remove(df: DataFrame, path: str) -> None:
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _moved_to(c: Centroids, state: DataFrame) -> Centroids:
    """The means, rounded down, of the vectors of each centroid; one without vectors stays.  Only a sum per centroid and component comes to the driver."""
    parts = state.filter("n IS NOT NULL").select("a", "n", F.posexplode("sums").alias("i", "s"))
    wide = lambda x: F.sum(F.col(x).cast("decimal(38,0)"))
    at = c.at.copy()
    for a, i, n, s in parts.groupBy("a", "i").agg(wide("n").alias("n"), wide("s").alias("s")).collect():
        at[a, i] = int(s) // int(n)
    return Centroids(at)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """Clusters ``vectors`` (``vec_id`` bigint, ``embedding`` array of numbers) around ``k`` centroids.

    Per vector that has exactly ``dim`` components, none null or non-finite: ``vec_id``, ``cluster``, ``distance``
    (squared, to the final centroid), ``cluster_inertia`` and ``inertia`` (its sum over the cluster and over all) and
    ``centroid_sha256``; ``size`` is the cluster's number of vectors.  Components count as ``floor(scale * x)``.
    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``<salt>:<vec_id>``, then smallest components;
    fewer vectors give fewer centroids, none give no rows.  A null id counts as an empty one in that text.  Repeated
    ids and vectors are vectors each.  Other columns are not read.  A component so large that squared distances would
    not fit 64 bits is an error.

    A round is one pass without a shuffle: it reads the vectors with their bounds from the shared checkpoint folder and
    writes them with the next ones, and drops the round before, so two rounds at most are stored, and a lost executor costs
    its tasks of one round.  ``k`` is at most :data:`MAX_CENTROIDS`.
    """
    if not (1 <= k <= MAX_CENTROIDS and rounds >= 1):
        raise ValueError(f"k must be from 1 to {MAX_CENTROIDS}, rounds 1 or more")
    spark = vectors.sparkSession
    finite = F.size("embedding") == dim
    finite &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(finite)
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = given.orderBy(key, "embedding").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, size bigint")
    c = Centroids(to_integers(np.array([x.embedding for x in seeds], float), scale))
    step, schema, old, moved = given.mapInArrow(_first_round(dim, scale, c), _STATE), _STATE, None, None
    for i in range(rounds + 1):
        if i:
            last = i == rounds
            schema = _FINAL if last else _STATE
            step = state.filter("v IS NOT NULL").select("vec_id", "v", "a", "b", "u", "l").mapInArrow(_round(dim, c, moved, last), schema)
        path = shared_path(spark, "shallot")
        step.write.parquet(path)
        if old:
            _remove(vectors, old)
        old, state = path, spark.read.schema(schema).parquet(path)
        if i < rounds:
            nxt = _moved_to(c, state)
            moved = np.sqrt(squares(nxt.at, c.at).astype(float)) * (1 + _ROOM)
            c = nxt
    totals = state.filter("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect()
    inertia = sum(int(x.t) for x in totals)
    about = spark.createDataFrame([(x.a, int(x.t), inertia, c.digest(x.a), x.n) for x in totals], "a int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, size bigint")
    return state.filter("n IS NULL").join(F.broadcast(about), "a").select("vec_id", F.col("a").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256", "size")
