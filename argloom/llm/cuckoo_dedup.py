"""Exact deduplication with a cuckoo-filter index of live digests.

Texts are equal when they are identical after deleting the bytes 0x20 and
0x09-0x0D.  The index is dealt over partitions by digest; their number follows the number of rows, so what
a task holds is bounded.  Each partition holds a cuckoo filter over the digests it owns and, beside it, the content: the
full digests in sorted order, which are buckets by their leading bits, with the number of rows and the best row of each.
A digest that misses the filter is new and goes in without a look at the content; one that hits is verified against its
bucket, so a false positive costs a look-up but never merges two texts.  Deleting a digest takes its
fingerprint out of the filter.  A filter that overflows is rebuilt at twice the size from the stored keys.

Copies are combined within each input task before the shuffle, so a text that
makes up a third of all rows reaches the index as one entry per task.

Defined results: a null text counts as empty, and all empty texts are one group;
a null id sorts after every other; of rows that repeat an id, the one whose text has the least hash comes first; rows
that repeat both id and text are one document and get the same verdict; an empty table gives an empty result; other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import broadcast_if_small, cut, shuffle_partitions

WHITE = "[\\x20\\x09-\\x0D]+"
_SLOTS = 4
_MAX_KICKS = 200
_NO_ID = (1 << 63) - 1
_SPREAD = np.uint64(0x5BD1E995)
#: Entries that go into an index at a time, that a combining task holds, and that a partition has on average at most.
_BATCH = 1 << 16
_COMBINE = 1 << 18
_PARTITION = 1 << 19
_FEW_IDS = 1_000_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints in buckets of four, over the digests in ``keys``.

    ``values`` has, for each of the sorted ``keys``, its number of rows, and code points, id and text hash of its best row.
    """

    def __init__(self, capacity: int = 1024):
        self.keys = np.zeros(0, "S32")
        self.values = np.zeros((0, 4), np.int64)
        self.resizes = self.looked_up = 0
        self._allocate(capacity)

    def _allocate(self, capacity: int) -> None:
        self.n = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / _SLOTS / 0.9))))
        self.table = np.zeros((self.n, _SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and the two buckets of each."""
        raw = np.frombuffer(keys.tobytes(), np.uint64).reshape(-1, 4)
        print_ = np.maximum(raw[:, 0] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        first = (raw[:, 1] & np.uint64(self.n - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, place: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return place ^ (print_.astype(np.uint64) * _SPREAD & np.uint64(self.n - 1)).astype(np.int64)

    def _fill(self, print_: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; true for those that found none."""
        order = np.argsort(place, kind="stable")
        place, print_ = place[order], print_[order]
        head = np.flatnonzero(np.diff(place, prepend=-1))
        turn = np.arange(len(place)) - np.repeat(head, np.diff(np.append(head, len(place))))
        used = self.table[place] != 0
        fits = turn < _SLOTS - used.sum(axis=1)
        slot = np.argsort(used, axis=1, kind="stable")[np.flatnonzero(fits), turn[fits]]
        self.table[place[fits], slot] = print_[fits]
        over = np.zeros(len(order), bool)
        over[order[~fits]] = True
        return over

    def _put(self, keys: np.ndarray) -> bool:
        """Adds fingerprints, kicking others to their second bucket where both are full; false if some found no place."""
        print_, first, second = self._places(keys)
        over = self._fill(print_, first)
        print_, place = print_[over], second[over]
        for kick in range(_MAX_KICKS):
            over = self._fill(print_, place)
            print_, place = print_[over], place[over]
            if not len(place):
                return True
            # One of those that wait at a full bucket takes a slot there; what it kicks, and the others, go on to their other bucket.
            full, one = np.unique(place, return_index=True)
            slot = (kick + print_[one]) % _SLOTS
            kicked = self.table[full, slot]
            self.table[full, slot] = print_[one]
            print_[one] = kicked
            place = self._other(place, print_)
        return False

    def _resize(self) -> None:
        """Doubles the table until it takes all stored keys."""
        capacity = self.n * _SLOTS
        while True:
            capacity *= 2
            self.resizes += 1
            self._allocate(capacity)
            if self._put(self.keys):
                return

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(keys)
        wanted = print_[:, None]
        return (self.table[first] == wanted).any(axis=1) | (self.table[second] == wanted).any(axis=1)

    def _verified(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of keys that hit the filter: their places in the content, and whether they are there."""
        self.looked_up += len(keys)
        at = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        there[inside] = self.keys[at[inside]] == keys[inside]
        return at, there

    def insert(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Adds entries (``S32`` digests; rows, code points, id, text hash); true for each digest, in sorted order, that was not live before."""
        keys, values = _combined(keys, values)
        hit = np.flatnonzero(self.might_hold(keys))
        at, there = self._verified(keys[hit])
        own, more = at[there], values[hit[there]]
        better = _before(more, self.values[own])
        self.values[own, 0] += more[:, 0]
        self.values[own[better], 1:] = more[better, 1:]
        new = np.ones(len(keys), bool)
        new[hit[there]] = False
        at = np.searchsorted(self.keys, keys[new])
        self.keys, self.values = np.insert(self.keys, at, keys[new]), np.insert(self.values, at, values[new], axis=0)
        if len(self.keys) > self.n * _SLOTS * 0.95 or not self._put(keys[new]):
            self._resize()
        return new

    def delete(self, keys: np.ndarray) -> int:
        """Retires the live ones of some digests; returns how many there were."""
        keys = np.unique(keys)
        keys = keys[self.might_hold(keys)]
        at, there = self._verified(keys)
        for print_, first, second in zip(*(x.tolist() for x in self._places(keys[there])), strict=True):
            place = first if (self.table[first] == print_).any() else second
            self.table[place, int(np.argmax(self.table[place] == print_))] = 0
        self.keys, self.values = np.delete(self.keys, at[there]), np.delete(self.values, at[there], axis=0)
        return int(there.sum())


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the best row of each of ``a`` comes before that of ``b``: more code points, then less id, then less text hash."""
    same, same_id = a[:, 1] == b[:, 1], a[:, 2] == b[:, 2]
    return (a[:, 1] > b[:, 1]) | (same & ((a[:, 2] < b[:, 2]) | (same_id & (a[:, 3] < b[:, 3]))))


def _combined(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their rows and their best row."""
    order = np.lexsort((values[:, 3], values[:, 2], -values[:, 1], keys))
    keys, values = keys[order], values[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    out = values[head]
    if len(head):
        out[:, 0] = np.add.reduceat(values[:, 0], head)
    return keys[head], out


_COLUMNS = ("digest", "group_size", "keep_chars", "keep_id", "keep_hash")
_ENTRY = "digest binary, group_size bigint, keep_chars bigint, keep_id bigint, keep_hash bigint"


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(index.keys), _BATCH):
        part = slice(i, i + _BATCH)
        digests = pa.Array.from_buffers(pa.binary(32), len(index.keys[part]), [None, pa.py_buffer(index.keys[part].tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([digests, *(pa.array(index.values[part, k]) for k in range(4))], names=list(_COLUMNS))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    digests = batch.column(0).cast(pa.binary(32))
    keys = np.frombuffer(digests.buffers()[1], "S32")[digests.offset : digests.offset + len(digests)]
    return keys, np.stack([batch.column(k).to_numpy() for k in range(1, 5)], axis=1)


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Whether digests are to be retired, the digests and their values, many at a time and in the order of the steps."""
    held, size, retire = [], 0, False

    def taken() -> tuple[bool, np.ndarray, np.ndarray]:
        keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
        return retire, keys, values

    for batch in batches:
        keys, values = _arrays(batch)
        gone = batch.column("retire").to_numpy(zero_copy_only=False) if batch.num_columns > 5 else np.zeros(len(keys), bool)
        turns = [0, *(np.flatnonzero(gone[1:] != gone[:-1]) + 1).tolist(), len(gone)]
        for i, j in zip(turns, turns[1:], strict=False):
            if i == j:
                continue
            if held and (gone[i] != retire or size >= _BATCH):
                yield taken()
                held, size = [], 0
            retire = bool(gone[i])
            held.append((keys[i:j], values[i:j]))
            size += j - i
    if held:
        yield taken()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for _, keys, values in _batched(batches):
        index.insert(keys, values)
        if len(index.keys) > _COMBINE:
            yield from _entries(index)
            index = CuckooIndex()
    yield from _entries(index)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for retire, keys, values in _batched(batches):
        if retire:
            index.delete(keys)
        else:
            index.insert(keys, values)
    yield from _entries(index)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``digest`` (SHA-256 of the text without white space), ``chars`` (code points of the original), ``text_hash`` (of the original)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.encode(F.regexp_replace(text, WHITE, ""), "UTF-8"), 256)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
        F.xxhash64(text).alias("text_hash"),
    )


def build_index(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The live digests of ``rows`` (as from :func:`digests`): one row per digest with its size and the row that stays."""
    given = rows.select("digest", F.lit(1).cast("bigint").alias("group_size"), F.col("chars").alias("keep_chars"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("keep_id"), F.col("text_hash").alias("keep_hash"))
    return update_index(None, given.mapInArrow(_combine, _ENTRY), None, partitions)


def update_index(index: DataFrame | None, added: DataFrame | None, retired: DataFrame | None, partitions: int | None = None) -> DataFrame:
    """Applies changes to an index: first ``retired`` digests are deleted from it, then the entries ``added`` are inserted.

    ``index`` and ``added`` have the columns that :func:`build_index` gives, ``retired`` has ``digest``.
    """
    n = partitions or shuffle_partitions((index if index is not None else added).sparkSession)
    steps = []
    if index is not None:
        steps.append(index.select(*_COLUMNS, F.lit(0).alias("step")))
    if retired is not None:
        steps.append(retired.select("digest", *(F.lit(0).cast("bigint").alias(c) for c in _COLUMNS[1:]), F.lit(1).alias("step")))
    if added is not None:
        steps.append(added.select(*_COLUMNS, F.lit(2).alias("step")))
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    dealt = every.repartition(n, "digest")
    if len(steps) > 1:
        dealt = dealt.sortWithinPartitions("step")
    return dealt.select(*_COLUMNS, (F.col("step") == 1).alias("retire")).mapInArrow(_own, _ENTRY)


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = cut(digests(docs, id_col, text_col))
    index = build_index(rows, max(shuffle_partitions(docs.sparkSession), 1 + rows.count() // _PARTITION))
    keep = F.when(F.col("keep_id") != _NO_ID, F.col("keep_id"))
    stays = (F.col("chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(keep) & (F.col("text_hash") == F.col("keep_hash"))
    return rows.join(index, "digest").select("doc_id", keep.alias("keep_id"), "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "text_hash")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in the original text stays, then the smallest id.
    """
    return _judged(docs, id_col, text_col).drop("text_hash")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row stands for; all columns stay as they are.  Only ids and hashes of the rows that go are joined to the texts."""
    gone = cut(_judged(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_argloom_id"), F.col("text_hash").alias("_argloom_hash")))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_argloom_id")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_argloom_hash"))
    return docs.join(broadcast_if_small(gone, _FEW_IDS), same, "left_anti")
