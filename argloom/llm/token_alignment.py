"""Alignment of the tokens of two tokenizers by the bytes that they cover.

Within a block of texts the tokens of each tokenizer are the rows of a sparse 0/1 matrix over the text's bytes, in
compressed rows built by hand.  Gustavson's row-by-row product of one with the transpose of the other gives the *overlap
links*: pairs of tokens with the number of bytes that they share.  Where a token of either kind ends at the same byte, both
token sequences are cut; the pieces are *groups*.  The product of the incidence of ids in groups gives the *shared-group
links*: pairs of ids with the number of pairs of their tokens that stand in one group.

A text is cut into segments at single spaces between visible characters.  Neither tokenizer makes a token across such a
place, so a segment's tokens, groups and links are the same wherever it stands, and matrices are built once for each
different segment that a task meets; a document's results are sums over its segments.

How many documents link a pair of ids is a count over all documents.  Documents are kept in chunks of bounded size that name
each pair once, so what is shuffled is a row per chunk and pair, however many documents of a chunk hold the pair.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import in_batches, shared_path
from argloom.llm._words import ranges

#: Bytes of text whose matrices are built at a time, and of a chunk of documents (one longer text goes alone).
BLOCK_BYTES, CHUNK_BYTES = 1 << 17, 1 << 22
#: Segments that a task remembers at most before it forgets all.
REMEMBERED = 200_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SEGMENT_END = re.compile(r" (?=\S)(?<=\S )")
#: Products of entries that a row product makes at a time (one larger row goes alone).
_PRODUCTS = 1 << 18
#: Segments of documents whose pairs are counted at a time (one larger document goes alone).
_SEGMENTS = 1 << 17


@dataclass(frozen=True)
class Csr:
    """A sparse matrix in compressed rows: row i has the columns ``indices[indptr[i]:indptr[i+1]]``, in order, with ``values``."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray | None = None) -> Csr:
        return cls(indptr, indices, np.ones(len(indices), np.int64) if values is None else values)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self, n_columns: int) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=n_columns))]), self.rows()[order], self.values[order])


def row_products(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, column, value`` of the product ``a b`` in blocks of rows.  By Gustavson: a row of the product is the sum of the rows of ``b`` that the entries of that row of ``a`` name, times their values."""
    width = np.diff(b.indptr)
    before = np.concatenate([[0], np.cumsum(width[a.indices])])
    i, n = 0, len(a.indptr) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(before[a.indptr], before[a.indptr[i]] + _PRODUCTS, side="right")) - 1)
        entry = slice(int(a.indptr[i]), int(a.indptr[j]))
        named = a.indices[entry]
        count = width[named]
        at = ranges(b.indptr[named], count)
        row = np.repeat(np.repeat(np.arange(i, j), np.diff(a.indptr[i : j + 1])), count)
        column, value = b.indices[at], np.repeat(a.values[entry], count) * b.values[at]
        i = j
        if not len(row):
            continue
        same = row[1:] == row[:-1]
        if (same & (column[1:] < column[:-1])).any():
            order = np.lexsort((column, row))
            row, column, value = row[order], column[order], value[order]
            same = row[1:] == row[:-1]
        new = np.flatnonzero(np.concatenate([[True], ~(same & (column[1:] == column[:-1]))]))
        yield row[new], column[new], np.add.reduceat(value, new)


class _Model:
    """Ids of texts, and for each id its bytes, their number, and its decimal form with room for a separator."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lens = np.array([len(x) for x in pieces], np.int64)
        decimal = [str(i).encode() + b"," for i in range(len(pieces))]
        self.digits = np.frombuffer(b"".join(decimal), np.uint8)
        self.digit_lens = np.array([len(x) for x in decimal], np.int64)
        self.digit_starts = np.cumsum(self.digit_lens) - self.digit_lens

    #: Whether a single space between visible characters always starts a token.
    splits_at_spaces = False

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class _ByteBpe(_Model):
    """A byte-level BPE file of the tokenizers library; a space goes before each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in set(plain)]
        byte_of = {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(rest)}
        vocabulary = self.tokenizer.get_vocab()
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            pieces[i] = bytes(byte_of[x] for x in piece) if all(x in byte_of for x in piece) else piece.encode()
        super().__init__(pieces)
        with open(path, encoding="utf-8") as file:
            before = json.load(file).get("pre_tokenizer") or {}
        self.splits_at_spaces = before.get("type") == "ByteLevel" and before.get("use_regex", True)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]


class _Pieces(_Model):
    """A SentencePiece model, which adds the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        one = self.processor
        super().__init__([bytes([int(one.id_to_piece(i)[3:5], 16)]) if one.is_byte(i) else one.id_to_piece(i).replace("▁", " ").encode() for i in range(one.get_piece_size())])
        self.splits_at_spaces = not any(re.search("[^▁]▁", one.id_to_piece(i)) for i in range(one.get_piece_size()))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


@lru_cache(2)
def _models(a: str, b: str) -> tuple[_Model, _Model]:
    return _ByteBpe(a), _Pieces(b)


@dataclass(frozen=True)
class Block:
    """Tokens of some consecutive documents over their common bytes; ``first_a[i]:first_a[i+1]`` are those of document i, and ``first_group`` its groups."""

    a: np.ndarray
    b: np.ndarray
    token_bytes: tuple[Csr, Csr]
    group_a: np.ndarray
    group_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_group: np.ndarray
    n_bytes: int

    @classmethod
    def of(cls, ids_a: list[list[int]], ids_b: list[list[int]], models: tuple[_Model, _Model]) -> Block:
        flat = lambda xs: np.fromiter(chain.from_iterable(xs), np.int64, sum(map(len, xs)))
        a, b = flat(ids_a), flat(ids_b)
        ends = [np.concatenate([[0], np.cumsum(m.lens[x])]) for m, x in zip(models, (a, b), strict=True)]
        n = int(ends[0][-1])
        cuts = np.intersect1d(ends[0][1:], ends[1][1:], assume_unique=True)
        group_a, group_b = (np.searchsorted(cuts, e[1:]) for e in ends)
        first_a, first_b = (np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64) for xs in (ids_a, ids_b))
        return cls(a, b, tuple(Csr.of(e, np.arange(n)) for e in ends), group_a, group_b, first_a, first_b, np.searchsorted(cuts, ends[0][first_a], side="right"), n)

    def overlap_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of tokens (their places in ``a`` and ``b``) with the bytes that they share."""
        left, right = self.token_bytes
        return row_products(left, right.transposed(self.n_bytes))

    def group_links(self, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys ``(document * ids of A + id of A) * n_b + id of B``, and the pairs of tokens in a common group; a document's key may come in several blocks."""
        n_groups = int(self.first_group[-1])
        document = np.repeat(np.arange(len(self.first_group) - 1), np.diff(self.first_group))
        key_a, times_a = np.unique(self.group_a << 32 | self.a, return_counts=True)
        key_b, times_b = np.unique(self.group_b << 32 | self.b, return_counts=True)
        ids_in_groups = Csr.of(np.arange(len(key_a) + 1), key_a >> 32, times_a)
        groups = Csr.of(np.concatenate([[0], np.cumsum(np.bincount(key_b >> 32, minlength=n_groups))]), key_b & 0xFFFFFFFF, times_b)
        for row, column, value in row_products(ids_in_groups, groups):
            yield document[key_a[row] >> 32], (key_a[row] & 0xFFFFFFFF) * n_b + column, value

    def in_decimal(self, models: tuple[_Model, _Model]) -> list[bytes]:
        """Of each document, its groups in decimal: ``a1,a2|b1;a3|b2,b3``."""
        n_groups = int(self.first_group[-1])
        in_a, in_b = np.bincount(self.group_a, minlength=n_groups), np.bincount(self.group_b, minlength=n_groups)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        n = len(self.a) + len(self.b)
        start, size, after = (np.empty(n, np.int64) for _ in range(3))
        for model, ids, place, last, mark in (
            (models[0], self.a, np.arange(len(self.a)) + (upto_b - in_b)[self.group_a], upto_a + upto_b - in_b - 1, b"|"),
            (models[1], self.b, np.arange(len(self.b)) + upto_a[self.group_b], upto_a + upto_b - 1, b";"),
        ):
            start[place], size[place], after[place] = model.digit_starts[ids] + (0 if mark == b"|" else len(models[0].digits)), model.digit_lens[ids], ord(",")
            after[last] = ord(mark)
        digits = np.concatenate([models[0].digits, models[1].digits])
        text = digits[ranges(start, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        text[ends[1:] - 1] = after
        whole, at = text.tobytes(), ends[self.first_a + self.first_b]
        return [whole[i : j - 1] for i, j in zip(at, at[1:], strict=False)]


def _counted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(value, new)


def _lengths(model: _Model, ids: list[list[int]]) -> list[int]:
    """The bytes of each list of ids."""
    n = np.array([len(x) for x in ids], np.int64)
    return _row_sums(model.lens[np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))], n).tolist()


def _ids_of_lines(model: _Model, texts: list[str], width: int = 256) -> list[list[int]]:
    """The ids of segments, made for lines of many of them; those that begin or end with white space go alone."""
    joined = [i for i, x in enumerate(texts) if not (x[0].isspace() or x[-1].isspace())]
    lines = [joined[i : i + width] for i in range(0, len(joined), width)]
    alone = sorted(set(range(len(texts))).difference(joined))
    found: list[list[int]] = [[]] * len(texts)
    for line, ids in zip(lines, model.ids([" ".join([texts[i] for i in line]) for line in lines]), strict=True):
        ends = np.cumsum(model.lens[ids])
        want = np.cumsum([len(texts[i].encode()) + 1 for i in line])
        at = np.searchsorted(ends, want)
        if not len(ends) or at[-1] >= len(ends) or (ends[at] != want).any():  # the model changes a text
            alone += line
        else:
            start = 0
            for i, stop in zip(line, (at + 1).tolist(), strict=True):
                found[i] = ids[start:stop]
                start = stop
    for i, ids in zip(alone, model.ids([texts[i] for i in alone]), strict=True):
        found[i] = ids
    return found


class _Lexicon:
    """The segments that a task has met: numbers (tokens of A and of B, groups, links, overlaps), groups in decimal, and linked pairs of ids with how often."""

    def __init__(self, models: tuple[_Model, _Model]):
        self.models = models
        self.at: dict[str, int] = {}
        self.decimal: list[bytes] = []
        self.whole: list[bool] = []
        self._parts: dict[str, list[np.ndarray]] = {x: [] for x in ("numbers", "n_pairs", "pair", "times")}

    def table(self, name: str) -> np.ndarray:
        """``numbers`` and ``n_pairs`` by segment; ``pair`` and ``times`` of all segments' links, one segment after the other."""
        parts = self._parts[name]
        if len(parts) != 1:
            parts[:] = [np.concatenate([*parts, np.zeros((0, 5) if name == "numbers" else 0, np.int64)])]
        return parts[0]

    def places(self, segments: list[str]) -> list[int]:
        new = [x for x in dict.fromkeys(segments) if x not in self.at]
        i = 0
        while i < len(new):
            j, size = i + 1, len(new[i])
            while j < len(new) and size + len(new[j]) <= BLOCK_BYTES:
                size += len(new[j])
                j += 1
            self._learn(new[i:j])
            i = j
        return [self.at[x] for x in segments]

    def _learn(self, texts: list[str]) -> None:
        """Texts whose tokens do not give back one space and the text have no tokens."""
        a = _ids_of_lines(self.models[0], texts) if self.models[0].splits_at_spaces else self.models[0].ids(texts)
        b = self.models[1].ids(texts)
        want = [b" " + x.encode() for x in texts]
        if all(b"".join(map(m.pieces.__getitem__, chain.from_iterable(x))) == b"".join(want) and _lengths(m, x) == list(map(len, want)) for m, x in zip(self.models, (a, b), strict=True)):
            whole = [True] * len(texts)
        else:
            whole = [all(b"".join(map(m.pieces.__getitem__, x)) == w for m, x in zip(self.models, (x, y), strict=True)) for x, y, w in zip(a, b, want, strict=True)]
            a, b = ([x if w else [] for x, w in zip(xs, whole, strict=True)] for xs in (a, b))
        self.at.update(zip(texts, range(len(self.at), len(self.at) + len(texts)), strict=True))
        self.whole += whole
        block = Block.of(a, b, self.models)
        n_b, n = len(self.models[1].pieces), len(texts)
        overlaps = np.zeros(n, np.int64)
        for row, _, _ in block.overlap_links():
            overlaps += np.bincount(np.searchsorted(block.first_a, row, side="right") - 1, minlength=n)
        links, wide, keys, values = np.zeros(n, np.int64), len(self.models[0].pieces) * n_b, [], []
        for document, pair, value in block.group_links(n_b):
            np.add.at(links, document, value)
            keys.append(document * wide + pair)
            values.append(value)
        key, value = _counted(keys, values)
        new = (np.stack([np.diff(block.first_a), np.diff(block.first_b), np.diff(block.first_group), links, overlaps], axis=1), np.bincount(key // wide, minlength=n), key % wide, value)
        for part, values_ in zip(self._parts.values(), new, strict=True):
            part.append(values_)
        self.decimal += block.in_decimal(self.models)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]


def _row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over the first ``counts[0]`` rows, the next ``counts[1]``, and so on."""
    return np.diff(np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])[np.concatenate([[0], np.cumsum(counts)])], axis=0)


class _Chunk:
    """Documents of about :data:`CHUNK_BYTES`, with the segments of each."""

    def __init__(self, lexicon: _Lexicon):
        self.lexicon = lexicon
        self.bytes = 0
        self.doc_ids: list = []
        self.digests: list[str] = []
        self.segments: list[np.ndarray] = []

    def add(self, doc_ids: list, texts: list[str]) -> None:
        known, split = self.lexicon, all(m.splits_at_spaces for m in self.lexicon.models)
        parts = [(_SEGMENT_END.split(x) if split else [x]) if x else [] for x in texts]
        flat, i = known.places([x for p in parts for x in p]), 0
        for text, part in zip(texts, parts, strict=True):
            at = flat[i : i + len(part)]
            i += len(part)
            if not all(map(known.whole.__getitem__, at)):
                at = [x for x in known.places([text]) if known.whole[x]]
            self.digests.append(hashlib.sha256(b";".join(map(known.decimal.__getitem__, at))).hexdigest() if at else "")
            self.segments.append(np.array(at, np.int64))
            self.bytes += len(text)
        self.doc_ids += doc_ids

    def row(self, chunk: int, id_type: pa.DataType) -> pa.RecordBatch:
        known, n_docs = self.lexicon, len(self.doc_ids)
        used, segment = np.unique(np.concatenate([*self.segments, np.zeros(0, np.int64)]), return_inverse=True)
        n_segments = np.array([len(x) for x in self.segments], np.int64)
        numbers, totals = known.table("numbers")[used], np.zeros((n_docs, 5), np.int64)
        every = known.table("n_pairs")
        n_pairs = every[used]
        links = ranges((np.cumsum(every) - every)[used], n_pairs)
        pairs, place = np.unique(known.table("pair")[links], return_inverse=True)
        documents, first, width = np.zeros(len(pairs), np.int64), np.cumsum(n_pairs) - n_pairs, max(len(pairs), 1)
        ends, i = np.concatenate([[0], np.cumsum(n_segments)]), 0
        while i < n_docs:  # a document's pairs once each, some documents at a time
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _SEGMENTS, side="right")) - 1)
            own = segment[ends[i] : ends[j]]
            totals[i:j] = _row_sums(numbers[own], n_segments[i:j])
            once = _distinct(np.repeat(np.arange(j - i), n_segments[i:j]) * max(len(used), 1) + own)
            document, of = np.divmod(once, max(len(used), 1))
            held = _distinct(np.repeat(document, n_pairs[of]) * width + place[ranges(first[of], n_pairs[of])])
            documents += np.bincount(held % width, minlength=width)[: len(pairs)]
            i = j
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        packed = lambda x: pa.array([np.ascontiguousarray(x, "<i4").tobytes()])
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), one(self.doc_ids, id_type), *(one(x, pa.int64()) for x in totals.T), one(self.digests, pa.string()), one(n_segments, pa.int64()), packed(segment), packed(n_pairs), packed(place), pa.array([known.table("times")[links].astype("<i8").tobytes()]), one(pairs, pa.int64()), one(documents, pa.int64())],
            names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "n_segments", "segment", "n_pairs", "place", "times", "pairs", "documents"],
        )


def _given_back() -> None:
    """Gives freed memory back to the system, where the C library can; else a worker keeps its peak while later stages run."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(_models(path_a, path_b))
        chunk, number, id_type = _Chunk(lexicon), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            id_type = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            i = 0
            while i < len(ids):
                j, size = i + 1, len(texts[i])
                while j < len(ids) and size + len(texts[j]) <= BLOCK_BYTES:
                    size += len(texts[j])
                    j += 1
                chunk.add(ids[i:j], texts[i:j])
                i = j
                if chunk.bytes >= CHUNK_BYTES:
                    yield chunk.row(number, id_type)
                    if len(lexicon.at) > REMEMBERED:
                        lexicon = _Lexicon(lexicon.models)
                    chunk, number = _Chunk(lexicon), number + 1
                    _given_back()
        if chunk.doc_ids:
            yield chunk.row(number, id_type)
        del chunk, lexicon
        _given_back()

    return run


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256"]


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the corpus-wide counts of a chunk's pairs over each document's links."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            array = lambda name: row.column(name).flatten()  # noqa: B023, E731
            found = array("found")
            count, top = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
            if len(found):
                at = found.field("at").to_numpy()
                count[at], top[at] = found.field("count").to_numpy(), found.field("top").to_numpy(zero_copy_only=False)
            segment, n_pairs, place = (np.frombuffer(row.column(name)[0].as_buffer(), "<i4") for name in ("segment", "n_pairs", "place"))  # noqa: B023
            times = np.frombuffer(row.column("times")[0].as_buffer(), "<i8")
            total = lambda x: _row_sums(_row_sums(times * x[place], n_pairs)[segment], array("n_segments").to_numpy())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(array(x) for x in _OUT), pa.array(total(top)), pa.array(total(count))], names=[*_OUT, "n_best", "count_sum"])


def align(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """Aligns the tokens of ``docs`` (``doc_id``, ``text``) by the files ``byte_bpe`` (A, tokenizers library) and ``pieces`` (B, SentencePiece).

    Per row: ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (pairs of an A and a B token in one group), ``n_overlaps`` (pairs
    that share a byte), ``groups_sha256``, ``n_best`` (links whose pair of ids is linked in as many documents as the best
    pair of that A id, ties included) and ``count_sum`` (that number, summed over the links).  A document that repeats
    counts each time.  A null or empty text, and one that either tokenizer does not give back byte for byte after one
    space, has no tokens: zeros, and an empty digest.  Other columns are not read; no rows give no rows.

    Tokens are made once; their links are stored in the shared checkpoint folder and read from there.
    """
    spark = docs.sparkSession
    spark.conf.set(_BATCH_BYTES, str(CHUNK_BYTES))  # rows are chunks: a worker is sent one or two at a time
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{x} array<{t}>" for x, t in [("doc_id", id_type), *((x, "bigint") for x in _OUT[1:6]), ("groups_sha256", "string"), ("n_segments", "bigint")])
    schema = f"chunk bigint, {lists}, segment binary, n_pairs binary, place binary, times binary, pairs array<bigint>, documents array<bigint>"
    path = shared_path(spark, "alignment")
    in_batches(docs.select("doc_id", "text")).mapInArrow(_align(byte_bpe, pieces), schema).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(schema).parquet(path)
    n_b = len(_Pieces(pieces).pieces)
    met = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "x")).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
    counts = met.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {n_b}"))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row per id of A at most
    known = counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("top"))
    found = met.select("chunk", "at", "pair").join(known, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "count", "top")).alias("found"))
    whole = chunks.drop("pairs", "documents").join(found, "chunk", "left")
    whole = whole.withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    out = ", ".join([f"doc_id {id_type}", *(f"{x} bigint" for x in _OUT[1:6]), "groups_sha256 string, n_best bigint, count_sum bigint"])
    return whole.mapInArrow(_looked_up, out)
