"""Vector joins in tiles of blocks, and by products of vectors as given."""

import numpy as np

from argloom.operators import vector_join as J

KINDS = "id int, label int, v array<double>"


def test_blocks_are_sent_to_tiles_and_not_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    v = np.random.default_rng(2).normal(size=(600, 6))
    df = spark.createDataFrame([(i, i % 2, row.tolist()) for i, row in enumerate(v)], KINDS)
    made = J.blocks(df, 6)
    pairs = J.block_pairs(made, -1.0)
    n, sent, met = made.count(), J._tiles(pairs, made).count(), pairs.count()
    assert sent < 10 * n < met
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.6)) if a < b and (b - a) % 2 == 0}
    got = [(r.a, r.b) for r in J.similar_pairs(df, 0.6, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    best = {(r.a, r.b) for r in J.top_partners(df, 2, 6, later=False).collect()}
    cosine = np.where((np.arange(600)[:, None] - np.arange(600)) % 2 == 0, unit @ unit.T, -9)
    np.fill_diagonal(cosine, -9)
    assert best == {(a, b) for a in range(600) for b in np.argsort(-cosine[a])[:2]}


def test_products_of_vectors_as_given(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    r = np.random.default_rng(4)
    v = r.normal(size=(120, 5)) * r.uniform(0.2, 3, size=(120, 1))
    v[:2] = [[0.5, 0, 0, 0, 0]] * 2  # on the threshold
    df = spark.createDataFrame([(i, 0, row.tolist()) for i, row in enumerate(v)], KINDS)
    product = v @ v.T
    for least, most in ((0.25, 0.9), (-0.5, 0.1)):
        want = {(a, b) for a in range(120) for b in range(a + 1, 120) if least <= round(product[a, b], 15) <= most}
        got = {(x.a, x.b): x.similarity for x in J.similar_pairs(df, least, 5, most, dot=True).collect()}
        assert set(got) == want and all(abs(s - product[p]) < 1e-12 for p, s in got.items())
        assert least < 0 or (0, 1) in got


def test_repeated_ids_give_a_pair_once(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.1]), (2, 0, [1.0, 0.05])]
    assert [(r.a, r.b) for r in J.similar_pairs(spark.createDataFrame(rows, KINDS), 0.5, 2).collect()] == [(1, 2)]
