"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is cut into pieces by a pattern; each distinct piece of a batch is encoded
once.  Pieces are put into matrices by length, one row each, padded on the right.
Every round, each row merges its leftmost pair of minimum rank: ranks of pairs
come from a hashed table, only the two pairs beside a merge are looked up anew,
and rows are compacted by one column.  Rows without a pair to merge leave.

A piece longer than ``LONG_PIECE`` bytes is a row of its own.  A round of it merges
all places of the minimum rank that do not overlap, which is what single merges
from the left would do, unless a pair that comes of a merge has no higher rank;
then the round makes the leftmost merge alone.  Rounds so follow the ranks that
the row meets, and a round looks at the places of one rank, not at the whole row.

Ids are kept as packed little-endian unsigned 32-bit integers in a binary column.

Defined results: a null or empty text gives no ids; other columns stay as they
are and a column of the output's name is replaced; an empty table gives an empty
result; the vocabulary file is a parameter and is read once per Python worker.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import in_batches
from argloom.llm._words import ranges

LONG_PIECE = 512
_NONE = np.int32(1 << 30)
#: Distinct pieces that a worker remembers.
_REMEMBERED = 100_000
#: Bytes of a column that are encoded or decoded at a time (one longer value goes alone).
_BATCH_BYTES = 1 << 20


def _width(n: int) -> int:
    """The width of the matrix for pieces of ``n`` bytes: at most a third more."""
    step = 1 << max(0, n.bit_length() - 3)
    return -(-n // step) * step


class PairTable:
    """An open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        left_keys, left_values = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._hash(left_keys)
        self.probes = 0
        while len(left_keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            done = free[one]
            self.keys[at[done]] = left_keys[done]
            self.values[at[done]] = left_values[done]
            rest = np.ones(len(left_keys), bool)
            rest[done] = False
            left_keys, left_values, at = left_keys[rest], left_values[rest], (at[rest] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges; a large number where there is none (ids below 0 are padding)."""
        left = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[left].astype(np.int64) << 32 | b[left]
        out = np.full(len(a), _NONE)
        at = self._hash(keys)
        for _ in range(self.probes):
            if not len(left):
                break
            there = self.keys[at]
            hit = there == keys
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != -1)
            left, keys, at = left[on], keys[on], (at[on] + 1) & self.mask
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        tokens = {r: t for t, r in ranks.items()}
        size = max(tokens) + 1
        lens = np.zeros(size, np.int64)
        for r, t in tokens.items():
            lens[r] = len(t)
        self.lens = lens
        self.at = np.cumsum(lens) - lens
        self.bytes = np.frombuffer(b"".join(tokens.get(r, b"") for r in range(size)), np.uint8)
        self.known: dict[str, bytes] = {}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new = set().union(*split).difference(self.known) if split else set()
        self._learn(list(new))
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in split]

    def _learn(self, pieces: list[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.known[piece] = self._merge_long(raw).astype("<u4").tobytes()
            else:
                by_length.setdefault(_width(len(raw)), []).append((piece, raw))
        for width, group in by_length.items():
            step = max(1, (1 << 20) // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.known.update(zip([piece for piece, _ in part], self._merge_matrix([raw for _, raw in part], width), strict=True))

    def _merge_matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        """Packed ids of each row; all rows have at most ``width`` bytes."""
        lens = np.array([len(r) for r in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        out = [b""] * len(rows)
        row = np.arange(len(rows))
        while len(row):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), int)
            merged = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), _NONE)
            on = merged < _NONE
            over = ids[~on]
            real = over >= 0
            packed, ends = over[real].astype("<u4").tobytes(), (4 * real.sum(axis=1).cumsum()).tolist()
            for i, start, end in zip(row[~on].tolist(), [0, *ends], ends, strict=False):
                out[i] = packed[start:end]
            row, ids, rank, best, merged = row[on], ids[on], rank[on], best[on], merged[on]
            if not len(row):
                break
            each = np.arange(len(row))
            ids[each, best] = merged
            width = ids.shape[1] - 1
            ids = np.take_along_axis(ids, np.arange(width) + (np.arange(width) > best[:, None]), axis=1)
            if width == 1:
                rank = np.zeros((len(row), 0), np.int32)
                continue
            rank = np.take_along_axis(rank, np.arange(width - 1) + (np.arange(width - 1) >= best[:, None]), axis=1)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.pairs.look_up(ids[left, best[left] - 1], ids[left, best[left]])
            right = np.flatnonzero(best < width - 1)
            rank[right, best[right]] = self.pairs.look_up(ids[right, best[right]], ids[right, best[right] + 1])
        return out

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """The ids of one long row.  A round merges all pairs of minimum rank that do not overlap, from the left; only the leftmost one if a pair that comes of them has no higher rank."""
        ids = self.byte[np.frombuffer(raw, np.uint8)].copy()
        n = len(ids)
        after, before, live = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank = np.append(self.pairs.look_up(ids[:-1], ids[1:]), _NONE)
        places: dict[int, list[np.ndarray]] = {}

        def note(at: np.ndarray) -> None:
            """Files places under the ranks of their pairs."""
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            found, first = np.unique(rank[at], return_index=True)
            for r, part in zip(found.tolist(), np.split(at, first[1:]), strict=True) if len(at) else ():
                if r not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(part)

        def merge(left: np.ndarray, r: int) -> np.ndarray:
            """Merges each of ``left`` with what follows; gives back the places whose pairs are new."""
            right = after[left]
            beyond = after[right]
            ids[left], live[right], after[left], rank[right] = r, False, beyond, _NONE
            inner = beyond < n
            before[beyond[inner]] = left[inner]
            new = np.unique(np.concatenate([left, before[left][before[left] >= 0]]))
            new = new[live[new]]
            paired = new[after[new] < n]
            rank[new] = _NONE
            rank[paired] = self.pairs.look_up(ids[paired], ids[after[paired]])
            return new

        ranks: list[int] = []
        note(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[live[at] & (rank[at] == r)]
            if not len(at):
                continue
            start = np.concatenate([[True], after[at[:-1]] != at[1:]])  # of runs of pairs that overlap
            first = np.flatnonzero(start)[np.cumsum(start) - 1]
            left = at[(np.arange(len(at)) - first) % 2 == 0]
            right = after[left]
            beyond, front = after[right], before[left]
            a = np.where(front >= 0, ids[np.maximum(front, 0)], -1)
            touch = np.concatenate([[False], beyond[:-1] == left[1:]])
            a = np.where(touch, r, a)
            b = np.where(beyond < n, ids[np.minimum(beyond, n - 1)], -1)
            made = np.full(len(left), r, np.int32)
            least = min(int(self.pairs.look_up(a.astype(np.int32), made).min()), int(self.pairs.look_up(made, b.astype(np.int32)).min()))
            if least <= r and len(left) > 1:
                new = merge(left[:1], r)
                note(np.concatenate([new, at[1:][rank[at[1:]] == r]]))
            else:
                note(merge(left, r))
        return ids[live]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        return self.bytes[ranges(self.at[ids], self.lens[ids])].tobytes()


@functools.lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive parts of about ``_BATCH_BYTES`` of ``column``, so that a worker's memory doesn't follow the batch."""
    at = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + _BATCH_BYTES, side="right")))
        yield batch.slice(i, j - i)
        i = j


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with ``out_col``: the packed ids of the text; and with ``decoded_col``, if given: the bytes that these ids stand for.

    Encoding and decoding in one pass takes one worker, and so one copy of the vocabulary, for each task instead of two.
    """
    new = [c for c in (out_col, decoded_col) if c is not None]
    kept = [c for c in df.columns if c not in new]
    given = in_batches(df.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("_argloom_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            for part in _parts(batch, "_argloom_text"):
                ids = own.encode_texts([t or "" for t in part.column("_argloom_text").to_pylist()])
                out = [pa.array(ids, pa.binary())]
                if decoded_col is not None:
                    out.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *out], names=[*kept, *new])

    return given.mapInArrow(run, given.drop("_argloom_text").select("*", *(F.lit(None).cast("binary").alias(c) for c in new)).schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the bytes that packed ids stand for."""
    kept = [c for c in df.columns if c != out_col]
    given = df.select(*(F.col(f"`{c}`") for c in kept), F.col(ids_col).alias("_argloom_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            for part in _parts(batch, "_argloom_ids"):
                texts = [own.decode(ids or b"") for ids in part.column("_argloom_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.binary())], names=[*kept, out_col])

    return given.mapInArrow(run, given.drop("_argloom_ids").withColumn(out_col, F.lit(None).cast("binary")).schema)


def token_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and decodes the ids again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return encode(given, rank_file, pattern, decoded_col="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
