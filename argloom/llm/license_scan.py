"""License scan: short notices found with a few edits, by exact seeds and bounded-error matching.

Texts are brought to a normal form: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space.
A notice is looked for with at most ``edits`` inserted, deleted or replaced code points.  Cut into ``edits + 1`` pieces,
at least one piece of it stands unchanged in every such place (the pigeonhole principle), so exact searches for the
pieces give all places that can match.  What stands around a piece is then either the notice itself, word for word, or
is matched by the ``regex`` library with its bound on errors.  Nothing else of a text is looked at twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm._spark import in_batches
from argloom.llm._words import text_buffers

#: Bytes of text that are normalised and searched at a time (one longer text goes alone).
CHUNK_BYTES = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Notice:
    """``phrase`` in normal form; words in brackets allow no edits (``under the [mit] license``)."""

    label: str
    phrase: str
    edits: int
    base: bool = False
    text: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "text", self.phrase.replace("[", "").replace("]", ""))
        if self.edits and len(self.text) < 2 * (self.edits + 1):
            raise ValueError(f"{self.edits} edits are too many for {self.text!r}")

    def pieces(self) -> list[tuple[int, bytes]]:
        """``edits + 1`` pieces of nearly equal length, with their places in the phrase."""
        at = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.text[a:b].encode()) for a, b in zip(at, at[1:], strict=False)]

    def pattern(self) -> regex.Pattern:
        """Between separators; words in brackets, and the spaces at them, as they are."""
        parts: list[str] = []
        for word in self.phrase.split(" "):
            if word.startswith("[") or not parts or parts[-1].startswith("["):
                parts.append(word)
            else:
                parts[-1] += " " + word
        body = " ".join(regex.escape(p[1:-1], literal_spaces=True) if p.startswith("[") else f"(?:{regex.escape(p, literal_spaces=True)}){{e<={self.edits}}}" for p in parts)
        return regex.compile(f"(?<=[ \\0]){body}(?=[ \\0])", regex.BESTMATCH)


#: The notices that are looked for.  The first three are the ones the contract names.
NOTICES = (
    Notice("mit", "under the [mit] license", 2, base=True),
    Notice("apache-2", "apache license version [2]", 3, base=True),
    Notice("cc-by-nc", "cc by nc", 0, base=True),
    Notice("mit", "the [mit] license", 1),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("gpl-3", "gnu general public license version [3]", 4),
    Notice("lgpl-3", "gnu lesser general public license version [3]", 4),
    Notice("bsd-3", "bsd [3] clause license", 2),
    Notice("mpl-2", "mozilla public license version [2]", 3),
    Notice("all-rights-reserved", "all rights reserved", 2),
)


class Normal:
    """The normal form of some consecutive texts: after each text stands a zero byte, before the first as well."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        ends = offsets[1:] + np.arange(n)  # of each text, with one byte put after each
        whole = np.zeros(len(data) + n, np.uint8)
        inner = np.ones(len(whole), bool)
        inner[ends] = False
        whole[inner] = _LOWER[data]
        word = _WORD[whole]
        before = np.concatenate([[False], word[:-1]])
        keep = word | before
        keep[ends] = True
        at = np.flatnonzero(keep)
        text = np.where(word, whole, 0x20)
        text[ends] = 0
        self.bytes = b"\0" + text[at].tobytes()
        self.at = np.concatenate([[-1], at])  # of each byte of the normal form, its place in ``whole``
        self.starts = np.flatnonzero((word & ~before)[at]) + 1  # of words, in the normal form
        self.text_ends = np.searchsorted(at, ends) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[0], self.text_ends]))
        self.points = np.concatenate([[0], np.cumsum((whole & 0xC0) != 0x80)])
        self.text_starts = offsets[:-1] + np.arange(n)

    def words(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self, place: int) -> int:
        return int(np.searchsorted(self.text_ends, place))


def _window(text: bytes, start: int, stop: int) -> tuple[int, str]:
    """The bytes from ``start`` to ``stop``, widened to whole code points, as a string, and where they start."""
    start, stop = max(start, 0), min(stop, len(text))
    while start > 0 and text[start] & 0xC0 == 0x80:
        start -= 1
    while stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop += 1
    return start, text[start:stop].decode("utf-8", "replace")


def _places(normal: bytes, notice: Notice, pattern: regex.Pattern) -> list[tuple[int, int, int]]:
    """``start, end, edits`` of a notice in a normal form."""
    want, e = notice.text.encode(), notice.edits
    seen, found = set(), set()
    for offset, piece in notice.pieces():
        hit = normal.find(piece)
        while hit >= 0:
            start = hit - offset
            if start not in seen:
                seen.add(start)
                if start > 0 and normal.startswith(want, start) and normal[start - 1] in b" \0" and normal[start + len(want)] in b" \0":
                    found.add((start, start + len(want), 0))
                elif e:
                    wide = 4 * (e + 1)  # so many bytes have the code points that edits may add, and one more
                    at, window = _window(normal, start - wide, start + len(want) + wide)
                    match = pattern.search(window)
                    if match and sum(match.fuzzy_counts) <= e:
                        a = at + len(window[: match.start()].encode())
                        found.add((a, a + len(match.group().encode()), sum(match.fuzzy_counts)))
            hit = normal.find(piece, hit + 1)
    return sorted(found)


def _apart(places: list[tuple[int, int, int, bool, int]]) -> list[tuple[int, int, int, bool, int]]:
    """``start, stop, edits, base, letters`` of one label, without those that overlap a better one: base places stay, then fewer edits, then longer ones, then the first."""
    kept: list[tuple[int, int, int, bool, int]] = []
    for place in sorted(places):
        while kept and place[0] < kept[-1][1]:
            better, worse = sorted((kept[-1], place), key=lambda x: (not x[3], x[2], x[0] - x[1], x[0]))
            if worse[3]:
                break
            if worse is place:
                place = None
                break
            kept.pop()
            place = better
        if place:
            kept.append(place)
    return kept


def _scan(batches: Iterator[pa.RecordBatch], notices: tuple[Notice, ...]) -> Iterator[pa.RecordBatch]:
    compiled: dict[str, list] = {}
    for x in notices:
        compiled.setdefault(x.label, []).append((x, x.pattern()))
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1)
            normal = Normal(data[at[i] : at[j]], at[i : j + 1] - at[i])
            found: list[list[dict]] = [[] for _ in range(j - i)]
            for label, same in compiled.items():
                for start, stop, edits, base, letters in _apart([(*x, notice.base and not x[2], len(notice.text)) for notice, pattern in same for x in _places(normal.bytes, notice, pattern)]):
                    k = normal.text_of(start)
                    origin = normal.points[normal.text_starts[k]]
                    found[k].append({
                        "label": label,
                        "base": base,
                        "word": int(np.searchsorted(normal.starts, start) - normal.first[k]),
                        "start": int(normal.points[normal.at[start]] - origin),
                        "stop": int(normal.points[normal.at[stop - 1] + 1] - origin),
                        "edits": edits,
                        "similarity": 1 - edits / letters,
                    })
            rows = [sorted(x, key=lambda y: (y["start"], y["label"], y["stop"])) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(normal.words(), pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_words", "notices"])
            i = j


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_words`` and ``notices``, an array by place of
    (``label``, ``base``, ``word``, ``start``, ``stop``, ``edits``, ``similarity``).

    ``word`` is the number of words before the place; ``start`` and ``stop`` are code points of the text as given, the
    end exclusive; ``base`` marks a contracted phrase that stands there word for word.  A notice begins and ends at
    words' ends.  Of places with one label that overlap, the base ones stay, and else the one with the fewest edits,
    the longest, the first; places with different labels may overlap.  A null or empty text has no words and no notices; rows that repeat are reported each; other
    columns of ``docs`` are not read, whatever their names; no rows give no rows.  A task holds one chunk of texts at a time.
    """
    given = in_batches(docs.select("doc_id", "text"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, notices array<struct<label:string,base:boolean,word:bigint,start:bigint,stop:bigint,edits:int,similarity:double>>"
    return given.mapInArrow(lambda batches: _scan(batches, notices), schema)


def notice_digest(found: DataFrame) -> DataFrame:
    """One row per row of :func:`find_notices`: places and labels of the base phrases, all labels, and ``score``, the similarity of the closest notice (0 without one)."""
    base = F.filter("notices", lambda x: x["base"])
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: x["similarity"])), F.lit(0.0)).alias("score"),
        F.size("notices").cast("bigint").alias("n_notices"),
        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["stop"].cast("string"), x["edits"].cast("string"))), ",").alias("spans"),
    )
