"""A gated recurrent language model for whole documents.

Words are lower-cased runs of non-space characters; every document ends with one
end token.  The model is a GRU in numpy whose output softmax is factored into classes
of words by frequency: P(word) = P(class) * P(word in class).  Words outside the
model's vocabulary are one of its words, times their share of the smoothed
unigram distribution among such words, so probabilities sum to one over all words.

Training is distributed.  Documents are written once as ids of the model's words, two bytes a word,
and dealt into blocks by a hash of their id and text.  There are ``ROUNDS`` rounds; each block of a round trains a copy of the
model by truncated back-propagation through time, and the copies are averaged with Spark, weighted by tokens.  The rounds
partition the blocks, so every training document is learned from once, whole.  Rows of a block are
put in order first, so that how the input is partitioned changes nothing.

Scoring deals documents into blocks.  A block asks for the counts of its distinct words
by word hash, so neither the vocabulary nor its counts are ever broadcast; only the
model is, whose size is fixed.  Within a block, documents run in lanes through
windows of ``WINDOW`` steps, the state carried from window to window, so a long document
is scored as a whole.

Defined results: a null or empty text is the end token alone; a null id is training text;
repeated rows count as often as they occur; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import cut, in_batches
from argloom.llm._words import chunks

#: The hash that stands for the end token.
END = np.uint64(0x656E64)
VOCABULARY = 2048
#: A class of words has at least so many, and at least one in so many of the words before it.
CLASS_WORDS, CLASS_SHARE = 16, 4
UNITS = 16
WINDOW = 32
LANES = 1024
ROUNDS = 8
TRAIN_LANES, TRAIN_WINDOW = 512, 16
_RATE = 0.2
#: Characters of text in a training block on average.
_TRAIN_BLOCK = 6 << 20
_ROWS = 2048
#: Bytes of text in a scoring block, and distinct words in a bucket of counts, on average.
_BLOCK = 12 << 20
_BUCKET_WORDS = 2_000_000
_LEAST_BUCKETS = 32
_FLUSH = 2 << 20
_PIECES = 16


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def _tokens(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, token hashes (each text's words and the end) and where each text's start (one more entry at the end)."""
    for chunk in chunks(column, lower=True):
        at = chunk.first + np.arange(len(chunk) + 1)
        h = np.full(at[-1], END, np.uint64)
        word = np.ones(at[-1], bool)
        word[at[1:] - 1] = False
        h[word] = chunk.word_hashes()
        yield chunk.rows, h, at


@dataclass
class Model:
    """``hashes`` (sorted) of the vocabulary's words and their ids, in order of frequency; the words of class k have the ids ``starts[k] .. starts[k + 1] - 1``.

    Id 0 stands for all other words and is a class of its own.  Frequent classes are small and rare ones large, so that
    most words cost little.
    """

    hashes: np.ndarray
    ids: np.ndarray
    end: int
    starts: np.ndarray
    gates: np.ndarray  # input part of the three gates for each word
    recur: np.ndarray  # what the last state adds to each gate
    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    unknown = 0
    NAMES = ("gates", "recur", "classes", "class_bias", "words", "word_bias")

    def look_up(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], self.unknown)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1, dtype=np.int16), np.diff(self.starts))[ids]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float32)

    def with_flat(self, flat: np.ndarray) -> Model:
        new, at = Model(**self.__dict__), 0
        for n in self.NAMES:
            x = getattr(self, n)
            setattr(new, n, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return new


def new_model(top: list[tuple[int, int]], total: int) -> Model:
    """From the most frequent tokens (hash, count): output biases are their logarithmic frequencies, other weights small random values."""
    known = dict(top)
    known.setdefault(int(END), 0)
    entries = sorted(((c, h) for h, c in known.items()), key=lambda x: (-x[0], x[1]))
    counts = np.array([max(1, total - sum(known.values())), *(max(c, 0.5) for c, _ in entries)])
    starts = [0, 1]
    while starts[-1] < len(counts):
        starts.append(min(len(counts), starts[-1] + max(CLASS_WORDS, starts[-1] // CLASS_SHARE)))
    by_hash = sorted((h, i) for i, (_, h) in enumerate(entries, 1))
    rng = np.random.default_rng(7)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    of_class = np.add.reduceat(counts, starts[:-1])
    return Model(
        hashes=np.array([h for h, _ in by_hash], np.uint64),
        ids=np.array([i for _, i in by_hash], np.int64),
        end=next(i for h, i in by_hash if h == int(END)),
        starts=np.array(starts, np.int64),
        gates=normal(len(counts), 3 * UNITS),
        recur=normal(3 * UNITS, UNITS),
        classes=normal(UNITS, len(of_class)),
        class_bias=np.log(of_class / counts.sum()).astype(np.float32),
        words=normal(len(counts), UNITS),
        word_bias=np.log(counts / np.repeat(of_class, np.diff(starts))).astype(np.float32),
    )


def _step(m: Model, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The state after one word in every lane, and what it was made of; units are rows and lanes are columns."""
    a = m.recur @ h
    zr = x[: 2 * UNITS] + a[: 2 * UNITS]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r, q = zr[:UNITS], zr[UNITS:], a[2 * UNITS :]
    n = np.tanh(x[2 * UNITS :] + r * q)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, q


def _inputs(m: Model, words: np.ndarray) -> np.ndarray:
    """For each step, what the words before add to the gates (rows) in each lane (columns)."""
    return np.ascontiguousarray(m.gates[words].transpose(0, 2, 1))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Overwrites ``x`` with exponentials, and returns their sums.  Logits are clipped to where no exponential overflows."""
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _log_p(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The softmax's log probability of one column in each row; overwrites ``x``."""
    each = np.arange(len(x))
    total = _softmax(x)
    return np.log(x[each, target] / total)


def _by_class(m: Model, target: np.ndarray, cls: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Of targets in order of their class, for each class of more than one word: its words, where they are the target, and which of them is."""
    cuts = np.flatnonzero(np.diff(cls, prepend=-1)).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(cls)], strict=False):
        words = slice(*m.starts[cls[i] : cls[i] + 2].tolist())
        if words.stop - words.start > 1:
            yield words, slice(i, j), target[i:j] - words.start


def log_probs(m: Model, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target word after each state."""
    cls = m.class_of(target)
    order = np.argsort(cls, kind="stable")  # once for all classes, so that each is a slice
    states, target, cls = states[order], target[order], cls[order]
    found, out = np.empty(len(target), np.float32), np.empty(len(target), np.float32)
    for i in range(0, len(target), _ROWS):  # parts that stay in the processor's cache
        part = slice(i, i + _ROWS)
        found[part] = _log_p(states[part] @ m.classes + m.class_bias, cls[part])
    for words, rows, which in _by_class(m, target, cls):
        found[rows] += _log_p(states[rows] @ m.words[words].T + m.word_bias[words], which)
    out[order] = found
    return out


def _lanes(lengths: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals documents to lanes of about equal length: document order lane by lane, and the lanes' lengths (longest first)."""
    heap = [(0, k) for k in range(min(count, len(lengths)))]
    lanes: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        lanes[k].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), k))
    total = {k: n for n, k in heap}
    by = sorted(total, key=lambda k: (-total[k], k))
    return np.array([d for k in by for d in lanes[k]], np.int64), np.array([total[k] for k in by], np.int64)


def _laid_out(ids: np.ndarray, at: np.ndarray, order: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in lane order, the word before each (the end at a document's start), and whether it starts a document."""
    parts = [ids[at[d] : at[d + 1]] for d in order]
    target = np.concatenate(parts)
    starts = np.zeros(len(target), bool)
    lens = np.array([len(p) for p in parts])
    starts[np.cumsum(lens) - lens] = True
    before = np.empty_like(target)
    before[0:1] = end
    before[1:] = target[:-1]
    before[starts] = end
    return target, before, starts


def score_documents(m: Model, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log probability of each document; ``ids`` of all tokens, ``at`` where documents start."""
    lens = np.diff(at)
    order, lane = _lanes(lens, LANES)
    target, before, starts = _laid_out(ids, at, order, m.end)
    lane_at = np.cumsum(lane) - lane
    logp = np.zeros(len(target))
    h = np.zeros((UNITS, len(lane)), np.float32)
    for t in range(0, int(lane[0]), WINDOW):
        live = int(np.count_nonzero(lane > t))
        steps = min(WINDOW, int(lane[0]) - t)
        h = h[:, :live]
        states = np.empty((steps, live, UNITS), np.float32)
        where = np.minimum(lane_at[:live] + t + np.arange(steps)[:, None], (lane_at + lane - 1)[:live])
        x, goes_on = _inputs(m, before[where]), (~starts[where]).astype(np.float32)
        for s in range(steps):
            h = _step(m, x[s], h * goes_on[s])[0]
            states[s] = h.T
        real = t + np.arange(steps)[:, None] < lane[:live]
        logp[where[real]] = log_probs(m, states[real], target[where[real]])
    out = np.zeros(len(lens))
    out[order] = np.add.reduceat(logp, np.cumsum(lens[order]) - lens[order])
    return out


class Trainer:
    """Truncated back-propagation through time with adaptive steps; the state is carried from window to window."""

    def __init__(self, m: Model):
        self.m = m.with_flat(m.flat().copy())
        self.sums = {n: np.full_like(getattr(m, n), 1e-3) for n in Model.NAMES}
        self.tokens = 0

    def _apply(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        s = self.sums[name]
        s[at] += grad * grad
        getattr(self.m, name)[at] -= _RATE * grad / np.sqrt(s[at])

    def fit(self, ids: np.ndarray, at: np.ndarray) -> None:
        order, lane = _lanes(np.diff(at), TRAIN_LANES)
        target, before, starts = _laid_out(ids, at, order, self.m.end)
        lane_at = np.cumsum(lane) - lane
        h = np.zeros((UNITS, len(lane)), np.float32)
        for t in range(0, int(lane[0]), TRAIN_WINDOW):
            live = int(np.count_nonzero(lane > t))
            steps = min(TRAIN_WINDOW, int(lane[0]) - t)
            where = np.minimum(lane_at[:live] + t + np.arange(steps)[:, None], (lane_at + lane - 1)[:live])
            real = t + np.arange(steps)[:, None] < lane[:live]
            h = self._window(h[:, :live], target[where], before[where], (~starts[where]).astype(np.float32), real)
        self.tokens += len(target)

    def _window(self, h: np.ndarray, target: np.ndarray, before: np.ndarray, goes_on: np.ndarray, real: np.ndarray) -> np.ndarray:
        m, (steps, live) = self.m, target.shape
        x, kept = _inputs(m, before), []
        states = np.empty((steps, live, UNITS), np.float32)
        for s in range(steps):
            h = h * goes_on[s]
            new = _step(m, x[s], h)
            kept.append((h, *new[1:]))
            h = new[0]
            states[s] = h.T
        full = bool(real.all())  # as long as no lane has ended, which is most of the time
        if full:
            d_states = self._softmaxes(states.reshape(-1, UNITS), target.ravel()).reshape(states.shape)
        else:
            d_states = np.zeros((steps, live, UNITS), np.float32)
            d_states[real] = self._softmaxes(states[real], target[real])
        d_states = np.ascontiguousarray(d_states.transpose(0, 2, 1))
        d_gates = np.empty((steps, 3 * UNITS, live), np.float32)
        d_h, d_a = np.zeros((UNITS, live), np.float32), np.empty((3 * UNITS, live), np.float32)
        g_recur = np.zeros_like(m.recur)
        for s in range(steps - 1, -1, -1):
            h0, z, r, n, q = kept[s]
            d_h += d_states[s]
            d, e = d_gates[s], d_a
            d_z, d_r, d_n = d[:UNITS], d[UNITS : 2 * UNITS], d[2 * UNITS :]
            np.multiply(1 - z, d_h, out=d_n)
            np.multiply(h0 - n, d_n, out=d_z)
            d_z *= z
            n *= n
            d_n *= 1 - n
            np.multiply(d_n, r, out=e[2 * UNITS :])
            np.multiply(e[2 * UNITS :], q, out=d_r)
            d_r *= 1 - r
            e[: 2 * UNITS] = d[: 2 * UNITS]
            g_recur += e @ h0.T
            d_h *= z
            d_h += m.recur.T @ e
            d_h *= goes_on[s]
        self._apply("recur", np.clip(g_recur, -1, 1))
        dg = d_gates.transpose(0, 2, 1)
        word, dg = (before.ravel(), dg.reshape(-1, 3 * UNITS)) if full else (before[real], dg[real])
        order = np.argsort(word.astype(np.uint16), kind="stable")
        word = word[order]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        self._apply("gates", np.add.reduceat(dg[order], first), word[first])
        return h

    def _softmaxes(self, flat: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Learns the output layers from states and the words after them, and returns the states' gradient."""
        m, cls = self.m, self.m.class_of(y)
        order = np.argsort(cls, kind="stable")
        flat, y, cls = flat[order], y[order], cls[order]
        scale = np.float32(1 / TRAIN_LANES)  # also where few long documents are left, so that they do not count for more
        grad = np.empty_like(flat)
        g_classes, g_class_bias = np.zeros_like(m.classes), np.zeros_like(m.class_bias)

        def slope(p: np.ndarray, target: np.ndarray) -> np.ndarray:
            p *= (scale / _softmax(p))[:, None]
            p[np.arange(len(p)), target] -= scale
            return p

        for i in range(0, len(y), _ROWS):
            part = slice(i, i + _ROWS)
            p = slope(flat[part] @ m.classes + m.class_bias, cls[part])
            grad[part] = p @ m.classes.T
            g_classes += flat[part].T @ p
            g_class_bias += p.sum(axis=0)
        g_words, g_word_bias = np.zeros_like(m.words), np.zeros_like(m.word_bias)
        for words, rows, which in _by_class(m, y, cls):
            own = flat[rows]
            q = slope(own @ m.words[words].T + m.word_bias[words], which)
            grad[rows] += q @ m.words[words]
            g_words[words], g_word_bias[words] = q.T @ own, q.sum(axis=0)
        self._apply("words", g_words)
        self._apply("word_bias", g_word_bias)
        self._apply("classes", g_classes)
        self._apply("class_bias", g_class_bias)
        out = np.empty_like(grad)
        out[order] = grad
        return out


def _buckets(h: np.ndarray, down: np.uint64) -> Iterator[tuple[int, int, int]]:
    """Of sorted hashes: each bucket that is met, and where its hashes start and end."""
    b = (h >> down).astype(np.int64)
    starts = np.flatnonzero(np.diff(b, prepend=-1))
    return zip(b[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True)


def count_tokens(docs: DataFrame, bits: int) -> DataFrame:
    """Of ``text``: one row per bucket of token hashes: ``bucket, hashes`` (sorted) ``, counts``."""
    down = np.uint64(64 - bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            rows = [(b, h[i:j].tobytes(), c[i:j].astype("<u4").tobytes()) for b, i, j in _buckets(h, down)]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "hashes", "counts"])

        for batch in batches:
            for _, h, _ in _tokens(batch.column("text")):
                held.append(h)
                size += len(h)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
        c = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) > 0]))
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "hashes": pa.array([h[order][first].tobytes()], pa.binary()), "counts": pa.array([np.add.reduceat(c[order], first).tobytes()], pa.binary())})

    dealt = docs.select("text").mapInArrow(deal, "bucket int, hashes binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(merge, "bucket int, hashes binary, counts binary")


def _top(counts: DataFrame, k: int) -> tuple[list[tuple[int, int]], int, int]:
    """The ``k`` most frequent tokens, the number of tokens and of distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                best = np.lexsort((h, -c))[:k]
                rest = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[best]), pa.array(c[best]), pa.nulls(len(best), pa.int64())], names=["h", "c", "n"])
                yield pa.RecordBatch.from_arrays([rest, pa.array([c.sum()]), pa.array([len(h)])], names=["h", "c", "n"])

    found = cut(counts.select("hashes", "counts").mapInArrow(run, "h bigint, c bigint, n bigint"))
    whole = found.filter("h IS NULL").agg(F.sum("c"), F.sum("n")).first()
    top = found.filter("h IS NOT NULL").orderBy(F.desc("c"), "h").limit(k).collect()
    return [(r["h"] & (1 << 64) - 1, r["c"]) for r in top], whole[0] or 0, whole[1] or 0


def _average(copies: DataFrame) -> DataFrame:
    """From ``piece, block, weight, part``: the mean of each piece, summed in the order of the blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        w = table.column("weight").to_numpy()
        mean = sum(np.frombuffer(x, np.float64) * (k / w.sum()) for x, k in zip(table.column("part").to_pylist(), w, strict=True))
        return pa.table({"piece": table.column("piece")[:1], "block": table.column("block")[:1], "weight": [w.sum()], "part": pa.array([mean.tobytes()], pa.binary())})

    kind = "piece int, block int, weight double, part binary"
    some = copies.groupBy("piece", F.pmod("block", F.lit(32))).applyInArrow(lambda _, table: run(table), kind)
    return some.groupBy("piece").applyInArrow(run, kind)


def encoded(docs: DataFrame, model: Model, blocks: int) -> DataFrame:
    """Of ``doc_id, text``: ``block, row, doc_id, ids``; ``ids`` are the words and the end as ids of the model's vocabulary."""
    now = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h, at in _tokens(batch.column("text")):
                ids = now.value.look_up(h).astype("<u2")
                packed = pa.array([ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[rows] for c in ("block", "row", "doc_id")), packed], names=["block", "row", "doc_id", "ids"])

    row = F.xxhash64("doc_id", "text")
    return docs.select(F.pmod(row, F.lit(blocks)).cast("int").alias("block"), row.alias("row"), "doc_id", "text").mapInArrow(run, "block int, row bigint, doc_id bigint, ids binary")


def _learner(now) -> Callable[[tuple, pa.Table], pa.Table]:
    """Trains a copy of the broadcast model on one block."""

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        trainer = Trainer(now.value)
        table = table.sort_by([("row", "ascending"), ("doc_id", "ascending")])
        docs = [np.frombuffer(x, "<u2") for x in table.column("ids").to_pylist()]
        trainer.fit(np.concatenate(docs).astype(np.int32), np.append(0, np.cumsum([len(x) for x in docs])))
        parts = np.array_split(trainer.m.flat().astype(np.float64), _PIECES)
        return pa.table({"piece": pa.array(range(_PIECES), pa.int32()), "block": pa.array([key[0].as_py()] * _PIECES, pa.int32()), "weight": [float(trainer.tokens)] * _PIECES, "part": pa.array([p.tobytes() for p in parts], pa.binary())})

    return learn


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS, block_chars: int = _TRAIN_BLOCK) -> Model:
    """Averages what copies of the model learn from the blocks of ``docs`` (``doc_id, text``), round after round; each block is in one round."""
    sc = docs.sparkSession.sparkContext
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = cut(encoded(docs, model, rounds * max(1, round(chars / block_chars / rounds))))
    for k in range(rounds):
        now = sc.broadcast(model)
        copies = texts.filter(F.col("block") % rounds == k).groupBy("block").applyInArrow(_learner(now), "piece int, block int, weight double, part binary")
        learned = _average(copies).orderBy("piece").collect()
        if learned:
            model = model.with_flat(np.concatenate([np.frombuffer(r["part"], np.float64) for r in learned]))
        now.unpersist()
    return model


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_log10 double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  ``vocabulary`` is at most 65,536 words."""
    sc = docs.sparkSession.sparkContext
    doc_id, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = in_batches(docs.select(doc_id.alias("doc_id"), text.alias("text")))
    training = given.filter(~held_out(F.col("doc_id")))
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(_LEAST_BUCKETS, chars / 100 / _BUCKET_WORDS))))
    counts = cut(count_tokens(training, bits))
    top, total, distinct = _top(counts, vocabulary - 2)
    model = train(training, new_model(top, total), rounds)
    outside = total + distinct + 1 - sum(c + 1 for _, c in top)
    known = np.zeros(model.gates.shape[0], np.int64)
    known[model.look_up(np.array([h for h, _ in top], np.uint64))] = [c for _, c in top]
    shared = sc.broadcast((model, known, np.log10(outside), np.log10(total + distinct + 1)))

    blocks = max(1, int(np.ceil(chars / _BLOCK)))
    dealt = given.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))
    down = np.uint64(64 - bits)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        """The distinct words outside the model's vocabulary."""
        m = shared.value[0]
        found = []
        for column in table.column("text").chunks:
            for _, x, _ in _tokens(column):
                found.append(np.unique(x[m.look_up(x) == m.unknown]))
        h = np.unique(np.concatenate(found))
        rows = [(b, key[0].as_py(), h[i:j].tobytes()) for b, i, j in _buckets(h, down)] if len(h) else []
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("bucket", pa.int32()), ("block", pa.int32()), ("asked", pa.binary())))})

    def answer(asks: pa.Table, own: pa.Table) -> pa.Table:
        blocks_, hashes, found = [], [], []
        if own.num_rows:
            h, c = np.frombuffer(own.column("hashes")[0].as_py(), np.uint64), np.frombuffer(own.column("counts")[0].as_py(), np.int64)
            for block, asked in zip(asks.column("block").to_pylist(), asks.column("asked").to_pylist(), strict=True):
                asked = np.frombuffer(asked, np.uint64)
                at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                there = h[at] == asked
                blocks_.append(block)
                hashes.append(asked[there].tobytes())
                found.append(c[at[there]].astype("<u4").tobytes() if c.max() < 1 << 32 else c[at[there]].tobytes())
        return pa.table({"block": pa.array(blocks_, pa.int32()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(found, pa.binary())})

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(("doc_id", "held_out", "n_tokens", "n_known", "base_log10", "score"), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        m, known, log_outside, log_all = shared.value
        parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, f"<u{8 * len(b) // len(a)}").astype(np.int64)) for a, b in zip(answers.column("hashes").to_pylist(), answers.column("counts").to_pylist(), strict=True) if a]
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        n_known, base, logp = [], [], []
        ids, lens = [], []
        for column in texts.column("text").chunks:
            for _, x, at in _tokens(column):
                word = m.look_up(x)
                count = known[word]
                rare = np.flatnonzero(word == m.unknown)
                spot = np.minimum(np.searchsorted(h, x[rare]), len(h) - 1)
                count[rare] = np.where(h[spot] == x[rare], c[spot], 0)
                log_count = np.log10(count + 1.0)
                n_known.append(np.add.reduceat((count > 0).astype(np.int64), at[:-1]))
                base.append(np.add.reduceat(log_count - log_all, at[:-1]))
                logp.append(np.add.reduceat(np.where(word == m.unknown, log_count - log_outside, 0.0), at[:-1]))
                ids.append(word.astype(np.int32))
                lens.append(np.diff(at))
        ids, lens = np.concatenate(ids), np.concatenate(lens)
        whole = score_documents(m, ids, np.append(0, np.cumsum(lens))) / np.log(10) + np.concatenate(logp)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": lens, "n_known": np.concatenate(n_known), "base_log10": np.concatenate(base), "score": whole})

    dealt = dealt.withColumn("held_out", held_out(F.col("doc_id")))
    asks = dealt.groupBy("block").applyInArrow(ask, "bucket int, block int, asked binary")
    answers = asks.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer, "block int, hashes binary, counts binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("base_log10").alias("base_score"), "score")
