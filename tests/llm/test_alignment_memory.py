"""A task of the alignment makes its matrices and counts for bounded parts of a chunk at a time."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from argloom.llm import token_alignment as T

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def chunks(monkeypatch, docs):
    monkeypatch.setattr(T, "TaskContext", type("One", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    return list(T._align(*PATHS)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], names=["doc_id", "text"])])))


def test_counts_of_some_documents_at_a_time(monkeypatch):
    docs = ["the cat sat on the mat", "", None, "the mat the mat", "x" * 50, "a b c d e f g " * 9, "the cat"] * 3
    (want,) = chunks(monkeypatch, docs)
    monkeypatch.setattr(T, "_SEGMENTS", 4)
    (got,) = chunks(monkeypatch, docs)
    assert got.equals(want) and max(want.column("documents")[0].as_py()) > 3


def test_memory_of_a_chunk(monkeypatch):
    """Pairs of all of a chunk's documents are not held at once."""
    import tracemalloc

    r = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(2_000)]
    docs = [" ".join(words[i] for i in r.integers(0, len(words), 400)) for _ in range(300)]
    chunk = T._Chunk(T._Lexicon(T._models(*PATHS)))
    chunk.add(list(range(len(docs))), docs)
    peaks = []
    for segments in (1 << 30, 1 << 12):
        monkeypatch.setattr(T, "_SEGMENTS", segments)
        tracemalloc.start()
        chunk.row(0, pa.int64())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert 2 * peaks[1] < peaks[0]
