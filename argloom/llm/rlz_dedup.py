"""Substring deduplication by relative Lempel-Ziv parsing against every document before.

A word is removed when it lies in a window of ``words`` consecutive words whose
sequence also starts earlier: in a document with a smaller id, or earlier in
the same one.  Windows are judged on the input.

Index.  Every document is a reference.  It is indexed by anchors: of the n-grams of
half a window, each window selects the one with the least hash (winnowing), so
equal windows select equal anchors wherever they stand, and about one n-gram in six is an
anchor.  Anchors that occur once in the whole corpus cannot lie in a repeated window.

Parse.  Only the windows that selected a repeated anchor look up their first occurrence among
all reference windows.  Going through a document, neighbouring windows whose
first occurrences are neighbours too (the same reference at the same distance) form
a factor, the greedy copy from that reference; where the reference changes, at factor borders, each window
stands on its own look-up, so a window across a border is found if it occurs anywhere.  The
words of all factors are the duplicate spans.

Look-ups are dealt by hash, and what they find goes back in packed form to the block of documents that asked.  A task first settles what repeats within itself and sends each distinct
hash once, so a passage in a third of all rows arrives once per task.

Defined results: a null or empty text has no words and keeps none; a document
shorter than a window keeps all its words; rows that share an id are ordered by a hash of id and text, and
rows that repeat both are one document, parsed alike; a null id counts as the largest; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import in_batches
from argloom.llm._words import chunks, ranges, window_hashes

WINDOW = 20
#: Hashes that a task holds before it deals them out, and that a bucket has on average.
_FLUSH = 2 << 20
_BUCKET = 1 << 20
_DEALT = "bucket int, local boolean, docs binary, rows binary, count binary, pos binary, far binary, hash binary"
_DEALT_SCHEMA = pa.schema([("bucket", pa.int32()), ("local", pa.bool_()), *((c, pa.binary()) for c in ("docs", "rows", "count", "pos", "far", "hash"))])
_FOUND = "block int, rows binary, count binary, pos binary, far binary"
#: Characters of text in a block on average.
_BLOCK_CHARS = 8 << 20


def _small(x: np.ndarray) -> bytes:
    """Ascending positions of one row after another, as short differences where they fit."""
    d = np.diff(x, prepend=0).astype(np.int64)
    return b"s" + d.astype("<i2").tobytes() if len(d) == 0 or np.abs(d).max() < 1 << 15 else b"l" + d.astype("<i8").tobytes()


def _unsmall(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, "<i2" if x[:1] == b"s" else "<i8", offset=1).astype(np.int64))


def _selected(grams: np.ndarray, per: int) -> np.ndarray:
    """For each window of ``per`` n-grams, the index of the one with the least hash (the first, if several)."""
    if len(grams) < per:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, per)
    return view.argmin(axis=1) + np.arange(len(view))


class _Dealer:
    """Holds (row, position, hash), settles repeats within the task and deals each distinct hash out once."""

    def __init__(self, bits: int, flag_first: bool):
        self.down = np.uint64(64 - bits)
        self.bits = bits
        self.flag_first = flag_first
        self.rows: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int, row: int, pos: np.ndarray, hashes: np.ndarray) -> bool:
        if len(pos):
            self.rows.append((doc, row, pos, hashes))
            self.size += len(pos)
        return self.size >= _FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        self.rows.sort(key=lambda r: r[:2])
        doc, row = np.array([r[0] for r in self.rows], np.int64), np.array([r[1] for r in self.rows], np.int64)
        count = np.array([len(r[2]) for r in self.rows])
        pos, h = np.concatenate([r[2] for r in self.rows]), np.concatenate([r[3] for r in self.rows])
        self.rows, self.size = [], 0
        own = np.repeat(np.arange(len(doc)), count)
        order = np.argsort(h, kind="stable")
        head = np.ones(len(h), bool)
        head[1:] = h[order][1:] != h[order][:-1]
        lead = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(h))))
        first = np.zeros(len(h), bool)
        first[order[head]] = True
        far = np.zeros(len(h), np.uint32)
        far[order] = _distance(row[own[lead]], pos[lead], pos[order])
        same = np.zeros(len(h), bool)  # the first occurrence itself, met again in a row that repeats id and text
        same[order] = (row[own[lead]] == row[own[order]]) & (pos[lead] == pos[order])
        repeated = ~first & ~same
        if self.flag_first:
            many = np.zeros(len(h), bool)
            many[order] = np.repeat(np.add.reduceat(repeated[order], np.flatnonzero(head)) > 0, np.diff(np.append(np.flatnonzero(head), len(h))))
            repeated = many
        out = []
        bucket = (h >> self.down).astype(np.int64)
        for local, mask in ((True, repeated), (False, first)):
            which = np.flatnonzero(mask)
            which = which[np.argsort(bucket[which] if not local else row[own[which]] % (1 << self.bits), kind="stable")]
            by = bucket[which] if not local else row[own[which]] % (1 << self.bits)
            cuts = np.searchsorted(by, np.arange((1 << self.bits) + 1))
            for b in range(1 << self.bits):
                mine = which[cuts[b] : cuts[b + 1]]
                if len(mine):
                    rows, at = np.unique(own[mine], return_index=True)
                    counts = np.diff(np.append(at, len(mine)))
                    out.append((b, local, doc[rows].tobytes(), row[rows].tobytes(), counts.tobytes(), _small(pos[mine]), far[mine].tobytes() if local else b"", b"" if local else h[mine].tobytes()))
        for i in range(0, len(out), 32):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 32], strict=True), _DEALT_SCHEMA, strict=True)], schema=_DEALT_SCHEMA)


def _distance(row: np.ndarray, at: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A 32-bit name of a reference row and the distance to it: equal along a factor."""
    return (((row ^ (at - pos)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _settle(table: pa.Table, flag_first: bool, blocks: int) -> pa.Table:
    """Within one bucket: the rows and positions whose hash has an earlier occurrence (or, ``flag_first``, any other), packed by block of rows."""
    found, parts = [], []
    for local, docs, rows, count, pos, far, h in zip(*(table.column(c).to_pylist() for c in ("local", "docs", "rows", "count", "pos", "far", "hash")), strict=True):
        row, n, p = np.frombuffer(rows, np.int64), np.frombuffer(count, np.int64), _unsmall(pos)
        if local:
            found.append((np.repeat(row, n), p, np.frombuffer(far, np.uint32)))
        else:
            parts.append((np.frombuffer(docs, np.int64), row, n, p, np.frombuffer(h, np.uint64)))
    if parts:
        doc, row, n, pos, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        rank = np.empty(len(row), np.int64)
        rank[np.lexsort((row, doc))] = np.arange(len(row))
        own = np.repeat(np.arange(len(row)), n)
        order = np.lexsort((pos, rank[own], h))
        head = np.ones(len(h), bool)
        head[1:] = h[order][1:] != h[order][:-1]
        sizes = np.diff(np.append(np.flatnonzero(head), len(h)))
        lead = np.repeat(order[head], sizes)
        repeated = (row[own[lead]] != row[own[order]]) | (pos[lead] != pos[order])
        if flag_first:
            repeated = np.repeat(np.logical_or.reduceat(repeated, np.flatnonzero(head)), sizes)
        mine, lead = order[repeated], lead[repeated]
        found.append((row[own[mine]], pos[mine], _distance(row[own[lead]], pos[lead], pos[mine])))
    row, pos, far = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    block = row % blocks
    order = np.lexsort((pos, row, block))
    row, pos, far, block = row[order], pos[order], far[order], block[order]
    cuts = np.searchsorted(block, np.arange(blocks + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        mine = slice(cuts[b], cuts[b + 1])
        rows, at = np.unique(row[mine], return_index=True)
        out.append((b, rows.tobytes(), np.diff(np.append(at, cuts[b + 1] - cuts[b])).tobytes(), _small(pos[mine]), far[mine].tobytes()))
    return pa.table({n: pa.array([r[i] for r in out], pa.binary() if i else pa.int32()) for i, n in enumerate(("block", "rows", "count", "pos", "far"))})


class _Found:
    """Of one block: the positions and distances found for each row."""

    def __init__(self, table: pa.Table):
        parts = [(np.repeat(np.frombuffer(r, np.int64), np.frombuffer(n, np.int64)), _unsmall(p), np.frombuffer(f, np.uint32)) for r, n, p, f in zip(*(table.column(c).to_pylist() for c in ("rows", "count", "pos", "far")), strict=True)]
        row, pos, far = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        order = np.lexsort((pos, row))
        self.row, self.pos, self.far = row[order], pos[order], far[order]

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        mine = slice(np.searchsorted(self.row, row), np.searchsorted(self.row, row, side="right"))
        pos, one = np.unique(self.pos[mine], return_index=True)
        return pos, self.far[mine][one]


def _rows(batch: pa.RecordBatch | pa.Table, words: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Per text with at least ``words`` words: word hashes, doc and row."""
    docs, rows = batch.column("doc").to_pylist(), batch.column("row").to_pylist()
    for chunk in chunks(batch.column("text")):
        hashes = chunk.word_hashes()
        for i in np.flatnonzero(np.diff(chunk.first) >= words).tolist():
            r = chunk.rows.start + i
            yield hashes[chunk.first[i] : chunk.first[i + 1]], docs[r], rows[r]


def _deal_anchors(words: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    gram = words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(bits, True)
        for batch in batches:
            for w, doc, row in _rows(batch, words):
                g = window_hashes(w, gram)
                at = np.unique(_selected(g, words - gram + 1))
                if dealer.add(doc, row, at, g[at]):
                    yield from dealer.flush()
        yield from dealer.flush()

    return run


def _deal_windows(words: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    gram = words // 2

    def run(texts: pa.Table, anchors: pa.Table) -> pa.Table:
        dealer, out, found = _Dealer(bits, False), [], _Found(anchors)
        if len(found.row):
            for w, doc, row in _rows(texts, words):
                g = window_hashes(w, gram)
                shared = np.zeros(len(g), bool)
                shared[found.of(row)[0]] = True
                at = np.flatnonzero(shared[_selected(g, words - gram + 1)])
                if dealer.add(doc, row, at, window_hashes(w, words)[at]):
                    out += dealer.flush()
        out += dealer.flush()
        return pa.Table.from_batches(out, _DEALT_SCHEMA)

    return run


_PARSED = "doc_id bigint, n_words bigint, n_removed bigint, n_factors bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string"


def _parse(words: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_factors", pa.int64()), ("spans", span_type), ("kept_text", pa.string())])

    def run(texts: pa.Table, windows: pa.Table) -> pa.Table:
        found, out = _Found(windows), []
        ids, rows = texts.column("doc_id").to_pylist(), texts.column("row").to_pylist()
        for chunk in chunks(texts.column("text")):
            first = chunk.first
            gone = np.zeros(len(chunk.starts), bool)
            factors, spans = np.zeros(len(chunk), np.int64), []
            for i in range(len(chunk)):
                pos, far = found.of(rows[chunk.rows.start + i])
                own = []
                if len(pos):
                    factors[i] = 1 + np.count_nonzero((np.diff(pos) > 1) | (far[1:] != far[:-1]))
                    step = np.zeros(first[i + 1] - first[i] + 1, np.int64)
                    step[pos] += 1
                    step[pos + words] -= 1
                    covered = np.cumsum(step)[:-1] > 0
                    gone[first[i] : first[i + 1]] = covered
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    own = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                spans.append(own)
            n = np.diff(first)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            kept = np.flatnonzero(~gone)
            lens = chunk.ends[kept] - chunk.starts[kept]
            # Each kept word takes its bytes and a space; the last space of a text is cut off.
            begin = np.cumsum(lens + 1) - (lens + 1)
            joined = np.full(int((lens + 1).sum()), 0x20, np.uint8)
            joined[ranges(begin, lens)] = chunk.data[ranges(chunk.starts[kept], lens)]
            text_at = np.append(begin, len(joined))[np.concatenate([[0], np.cumsum(n - removed)])]
            raw = joined.tobytes()
            kept_texts = [raw[a : max(a, b - 1)] for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
            arrays = [pa.array(ids[chunk.rows], pa.int64()), pa.array(n), pa.array(removed), pa.array(factors), pa.array(spans, span_type), pa.array(kept_texts, pa.binary()).cast(pa.string())]
            out.append(pa.RecordBatch.from_arrays(arrays, schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def parse_against_earlier(docs: DataFrame, words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, n_factors, spans`` (of removed words, ends exclusive) ``, kept_text`` (the other words, joined by a space)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("bigint")
    given = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))
    chars = in_batches(given).agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // _BLOCK_CHARS))
    bits = lambda n: max(1, int(np.ceil(np.log2(max(2, n / _BUCKET)))))
    settled = lambda dealt, flag_first: dealt.groupBy("bucket").applyInArrow(lambda table: _settle(table, flag_first, blocks), _FOUND).groupBy("block")
    anchors = settled(given.select("doc", "row", "text").mapInArrow(_deal_anchors(words, bits(chars / 36)), _DEALT), True)
    by_block = given.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")).groupBy("block")
    windows = settled(by_block.cogroup(anchors).applyInArrow(_deal_windows(words, bits(chars / 18)), _DEALT), False)
    return by_block.cogroup(windows).applyInArrow(_parse(words), _PARSED)
