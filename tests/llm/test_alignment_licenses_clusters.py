"""The license scan, the token alignment and the centroid clustering against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from argloom.llm import queries, shallot, token_alignment
from argloom.llm.license_scan import NOTICES, Notice, find_notices, notice_digest

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# --- license scan ---------------------------------------------------------------------------------------------------


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base_columns(text):
    words, places, labels = words_of(text), [], set()
    for notice in NOTICES:
        phrase = notice.text.split(" ")
        for i in range(len(words)):
            if notice.base and words[i : i + len(phrase)] == phrase:
                places.append(i)
                labels.add(notice.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def fuzzy_places(text, notice):
    """Spans of whole words, in the text's words joined by spaces, that are within the edits of the notice, its exact words in their places."""
    words = words_of(text)
    found = set()
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 14) + 1):
            place = " ".join(words[i:j])
            if abs(len(place) - len(notice.text)) <= notice.edits and distance(place, notice.text) <= notice.edits and split_within(place, notice):
                found.add((i, j))
    return found


def split_within(place, notice):
    """Whether the place is the notice's parts in order, the words in brackets exactly, with all edits within the bound."""
    parts, costs = re.split(r" ?\[([^]]*)\] ?", notice.phrase), {0: 0}
    for k, part in enumerate(parts):
        if not part and k in (0, len(parts) - 1):
            continue
        after = {}
        for start, cost in costs.items():
            at = start + (1 if start else 0)
            if start and place[start : start + 1] != " ":
                continue
            for end in range(at, len(place) + 1):
                more = (0 if place[at:end] == part else 99) if k % 2 else distance(place[at:end], part)
                if cost + more <= notice.edits:
                    after[end] = min(after.get(end, 99), cost + more)
        costs = after
    return len(place) in costs


def docs_of(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("doc_id", "text", "'x' AS label", "1 AS n_words", "2 AS notices", "3 AS cluster") if extra else df


LICENSED = [
    None, "", "plain words", "Released under the MIT License.", "UNDER\tthe\nmit-license and under the mit license", "under the mpl license", "under the mit licence", "undr the mit licnse",
    "Licensed under the Apache License, Version 2.0.", "Apache Licence, version 1.1", "apach license version 2", "CC BY-NC 4.0; cc by nd", "cc by nc cc by nc", "xcc by nc", "GNU Générale Public License, version 3",
    "GNU General Public Licnse version 3", "İİ Ünder the MIT License ✓ under the MIT License", "all right reserved", "under the mit license\0under the mit licens", "under the mit license" * 3, "the " * 50 + "mit license",
]


def test_base_places_equal_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    texts = LICENSED + [r.text for r in documents.collect()] + ["x " * 30_000 + "Under the MIT License"]
    got = {r.doc_id: r for r in notice_digest(find_notices(docs_of(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_columns(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1.0 or not r.n_base)


def edited(rng, phrase, n):
    for _ in range(n):
        i = rng.randrange(len(phrase))
        kind = rng.randrange(3)
        phrase = phrase[:i] + ("é" if kind == 0 else rng.choice("ab1é") + phrase[i] if kind == 1 else "") + phrase[i + 1 :]
    return phrase


def test_fuzzy_labels_equal_brute_force(spark):
    rng = random.Random(4)
    texts = list(LICENSED)
    for notice in NOTICES:
        for _ in range(12):
            texts.append(f"Lorem {edited(rng, notice.text, rng.randrange(notice.edits + 3))}, ipsum the license of")
    got = {r.doc_id: r for r in notice_digest(find_notices(docs_of(spark, texts))).collect()}
    near = 0
    for i, text in enumerate(texts):
        want = {n.label for n in NOTICES if fuzzy_places(text, n)}
        near += bool(want)
        assert set(filter(None, got[i].labels.split(","))) == want, text
    assert near > 60


def test_spans_are_code_points_of_the_text(spark):
    texts = ["ß✓ Apache   License,\nVersion 2.0", "🙂 under the Mit Licence!", "a cc-BY-nc"]
    found = {r.doc_id: r.notices for r in find_notices(docs_of(spark, texts)).collect()}
    assert [texts[i][n.start : n.stop] for i in found for n in found[i]] == ["Apache   License,\nVersion 2", "under the Mit Licence", "cc-BY-nc"]


def test_scan_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert notice_digest(find_notices(empty)).count() == 0
    odd = spark.createDataFrame([(None, "cc by nc", 1), (None, "cc by nc", 1), (3, None, None)], "doc_id bigint, text string, score int")
    assert sorted((r.doc_id or -1, r.n_base, r.first_word, r.labels) for r in notice_digest(find_notices(odd)).collect()) == [(-1, 1, 0, "cc-by-nc"), (-1, 1, 0, "cc-by-nc"), (3, 0, None, "")]
    with pytest.raises(ValueError):
        Notice("x", "ab cd", 3)


# --- token alignment ------------------------------------------------------------------------------------------------


def links_by_hand(text):
    models = token_alignment._models(*FILES)
    a, b = (m.ids([text or "x"])[0] for m in models)
    if not text or any(b"".join(m.pieces[i] for i in ids) != b" " + text.encode() for m, ids in zip(models, (a, b), strict=True)):
        return 0, 0, [], [], 0
    spans = []
    for m, ids in zip(models, (a, b), strict=True):
        ends = np.cumsum([len(m.pieces[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids, strict=False)))
    cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
    groups = [tuple([i for s, e, i in side if lo <= s and e <= hi] for side in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)]
    overlaps = sum(s < f and t < e for s, e, _ in spans[0] for t, f, _ in spans[1])
    return len(a), len(b), groups, [(x, y) for p, q in groups for x in p for y in q], overlaps


MIXED = [None, "", "hello world", "ünïcode 日本語 text\n\n  two  spaces", "<|endoftext|> and <s> </s> <0x41>", "a" * 700, "▁ under", "\ttab\x00", "😀😀 family 👩‍👩‍👧", "line\r\nbreak  ", " lead", "hello world", "é ﬁ ①"]


def test_alignment_equals_brute_force(spark, monkeypatch):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = MIXED + [r.text[:1500] for r in documents.collect()]
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 8_000)
    hand = [links_by_hand(t) for t in texts]
    count = Counter(pair for _, _, _, links, _ in hand for pair in set(links))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    got = {r.doc_id: r for r in token_alignment.align(docs_of(spark, texts, extra=True), *FILES).collect()}
    assert len(got) == len(texts)
    for i, (n_a, n_b, groups, links, overlaps) in enumerate(hand):
        digest = hashlib.sha256(";".join("|".join(",".join(map(str, x)) for x in g) for g in groups).encode()).hexdigest() if n_a else ""
        best = sum(count[p] == most[p[0]] for p in links)
        assert tuple(got[i]) == (i, n_a, n_b, len(groups), len(links), overlaps, digest, best, sum(count[p] for p in links)), texts[i]
    assert {got[0].n_a, got[1].n_a} == {0} and got[2] == got[2]


def test_row_products_equal_dense_products(monkeypatch):
    monkeypatch.setattr(token_alignment, "_PRODUCTS", 7)
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = (rng.integers(0, 3, (rng.integers(1, 9), 6)) * rng.integers(0, 2, 6) for _ in range(2))
        sparse = []
        for m in (x, y):
            rows, columns = np.nonzero(m)
            sparse.append(token_alignment.Csr.of(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), columns, m[rows, columns]))
        got = np.zeros((len(x), len(y)), int)
        for row, column, value in token_alignment.row_products(sparse[0], sparse[1].transposed(6)):
            got[row, column] += value
        assert (got == x @ y.T).all()


def test_alignment_of_odd_tables(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), *FILES).count() == 0
    odd = spark.createDataFrame([(None, "tie", 1), (7, "tie", 1), (7, "tie", 2), (8, None, 3)], "doc_id bigint, text string, chunk int")
    got = token_alignment.align(odd, *FILES).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.n_best == r.n_links, r.count_sum == 3 * r.n_links) for r in got) == [(0, 1, True, True), (7, 1, True, True), (7, 1, True, True), (8, 0, True, True)]


# --- centroid clustering --------------------------------------------------------------------------------------------


def lloyd(ids, rows, k, rounds):
    """Plain rounds over Python integers."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"3:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), rows[i]))
    whole = [[int(np.floor(x * 1024)) for x in r] for r in rows]
    c = [whole[i] for i in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        a = [nearest(v)[1] for v in whole]
        for j in range(len(c)):
            own = [v for v, x in zip(whole, a, strict=True) if x == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [nearest(v) for v in whole], c


@pytest.mark.parametrize(("k", "dim", "n"), [(8, 3, 120), (5, 2, 60), (1, 2, 9), (8, 2, 4)])
def test_clusters_equal_plain_rounds(spark, k, dim, n):
    rng = np.random.default_rng(k + dim)
    rows = (rng.integers(-4, 5, (n, dim)) / 2048).tolist()  # many ties and equal vectors
    got = shallot.cluster(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>").repartition(3), k=k, dim=dim, rounds=4).toPandas().set_index("vec_id")
    want, c = lloyd(list(range(n)), rows, k, 4)
    assert [(d, j) for d, j in want] == [(got.distance[i], got.cluster[i]) for i in range(n)]
    assert set(got.inertia) == {sum(d for d, _ in want)}
    for j, m in enumerate(c):
        own = got[got.cluster == j]
        if len(own):
            assert set(own.centroid_sha256) == {hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()}
            assert set(own.cluster_inertia) == {sum(d for d, x in want if x == j)}


def test_clusters_of_the_table_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 150")
    given = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 150")
    want = con.sql(queries.OP13_SQL).df().sort_values("vec_id").reset_index(drop=True)
    got = shallot.cluster(given).toPandas().sort_values("vec_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


def test_clusters_of_odd_tables(spark):
    kind = "vec_id bigint, embedding array<float>, cluster int, a string"
    good = [0.5] * 64
    rows = [(1, good, 1, "x"), (1, good, 1, "x"), (None, [0.25] * 64, 2, None), (2, None, 0, ""), (3, good[:63], 0, ""), (4, [*good[:63], None], 0, ""), (5, [*good[:63], float("nan")], 0, ""), (6, [*good[:63], float("inf")], 0, "")]
    got = shallot.cluster(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (1, 0)]
    assert shallot.cluster(spark.createDataFrame(rows[3:], kind)).count() == 0
    assert shallot.cluster(spark.createDataFrame([], kind)).count() == 0
    with pytest.raises(ValueError):
        shallot.cluster(spark.createDataFrame([], kind), k=0)


def test_search_measures_fewer_centroids_than_a_full_scan(monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.integers(-100_000, 100_000, (64, 4))
    v = np.repeat(centers, 50, axis=0) + rng.integers(-50, 50, (3_200, 4))
    measured, plain = [0], shallot.squares
    c = shallot.Centroids(centers)
    monkeypatch.setattr(shallot, "squares", lambda x, y: measured.__setitem__(0, measured[0] + len(x)) or plain(x, y))
    first, second, d1, d2 = shallot.search(v, c, np.repeat(np.arange(64), 50), np.full(len(v), -1))
    every = np.stack([plain(v, m[None]) for m in centers], 1)
    assert (first == every.argmin(1)).all() and (d1 == every.min(1)).all() and (d2 == np.sort(every, 1)[:, 1]).all()
    assert measured[0] < 0.8 * v.shape[0] * 64


def test_arrow_vectors_survive_slices():
    v = np.arange(12).reshape(4, 3)
    packed = shallot._packed(v)
    assert (shallot._vectors(packed.slice(1, 2), 3) == v[1:3]).all()
    assert isinstance(packed, pa.Array)
