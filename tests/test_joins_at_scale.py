"""Vector joins, block search, phrase search, linking and formulas against brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from argloom.functions.formulas import deviation, deviations
from argloom.functions.text import dense, sparse_embedding
from argloom.operators import retrieval as R
from argloom.operators import vector_join as J
from argloom.operators.phrases import find_phrases
from argloom.operators.theory import claimants

VECTOR = "id int, label string, v array<double>"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    v = centers[rng.integers(0, 6, 90)] + 0.25 * rng.normal(size=(90, 8))
    v[7], v[8], v[9] = v[6], 2 * v[6], -v[6]
    rows = [(i, "xy"[i % 2] if i % 11 else None, x.tolist()) for i, x in enumerate(v)]
    return rows + [(200, "x", [0.0] * 8), (201, "x", None), (202, "x", [1.0] * 7), (203, "x", [None] + [1.0] * 7), (204, "x", [float("nan")] * 8), (3, "y", rows[3][2])]


def cosine(a, b):
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)


@pytest.mark.parametrize("least", [0.8, 0.2])
def test_similar_pairs_equal_brute_force(spark, vectors, least, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "PIVOTS", 5)
    monkeypatch.setattr(J, "STRIPE", 2)
    df = spark.createDataFrame(vectors, VECTOR).withColumn("similarity", F.lit("clash"))
    good = [r for r in vectors[:90] if r[1]]
    want = {(a[0], b[0]): cosine(a[2], b[2]) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and cosine(a[2], b[2]) >= least}
    got = {(r.a, r.b): round(r.similarity, 9) for r in J.similar_pairs(df, least, 8).collect()}
    assert got == want
    report = J.join_report(df, least, 8).first()
    assert report.found >= len(want) and report.verified <= report.met <= report.pairs
    if least == 0.8:
        assert report.met < report.pairs and report.verified < report.met


def test_top_partners_equal_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "PIVOTS", 5)
    good = [r for r in vectors[:90] if r[1]]
    df = spark.createDataFrame(vectors[:90], VECTOR)
    for later in (True, False):
        want = {}
        for a in good:
            others = sorted((-round(cosine(a[2], b[2]), 9), b[0]) for b in good if b[1] == a[1] and (b[0] > a[0] if later else b[0] != a[0]))
            want |= {(a[0], k + 1): b for k, (_, b) in enumerate(others[:3])}
        assert {(r.a, r.k): r.b for r in J.top_partners(df, 3, 8, later).collect()} == want


def test_vector_joins_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTOR)
    assert J.similar_pairs(none, 0.5, 8).count() == J.top_partners(none, 2, 8).count() == 0
    assert J.join_report(none, 0.5, 8).first().pairs == 0


def test_block_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox runs", "a fox", None, "", "blue sea", "red red red", "red fox runs", "sea of blue foxes"])], "doc_id int, text string")
    queries = spark.createDataFrame([("q1", "red fox"), ("q2", "blue sea"), ("q3", "")], "query_id string, text string")
    v = {r.id: np.array(r.v) for r in dense(sparse_embedding(docs, "doc_id", "text")).collect()}
    q = {r.id: np.array(r.v) for r in dense(sparse_embedding(queries, "query_id", "text")).collect()}
    want = {}
    for name, y in q.items():
        scored = sorted((-max(0.0, round(float(x @ y), 6)), i) for i, x in v.items() if ((x != 0) & (y != 0)).any())
        want |= {(name, k + 1): (i, -s) for k, (s, i) in enumerate(scored[:3])}
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in R.search(docs, queries, 3).collect()}
    assert got == want


def test_clusters_put_copies_together(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.1]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [-1.0, 0.0]), (8, [-1.0, 0.0])]
    got = {r.id: r.cluster for r in R.clusters(spark.createDataFrame(rows, "id int, v array<double>"), 0.9, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_consolidation_needs_like_relations(spark):
    v = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "p", [1.0, 0.01]), (3, "p", [1.0, 0.02]), (4, "q", [1.0, 0.0]), (5, None, [1.0, 0.0])], VECTOR)
    r = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "a")], "id int, signature string")
    assert {x.id: x.canonical for x in R.consolidate(v, r, 0.9, 0.8, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_linking_abstains_between_equals(spark):
    mentions = spark.createDataFrame([(1, "red fox"), (2, "deep blue sea"), (3, "zzz"), (4, None)], "mention_id int, text string")
    candidates = spark.createDataFrame([(10, "red fox"), (11, "blue sea"), (12, "blue sea"), (13, "stone")], "candidate_id int, text string")
    got = {r.mention_id: (r.outcome, r.candidate_id) for r in R.linked(mentions, candidates, 3, 0.4).collect()}
    assert got == {1: ("linked", 10), 2: ("ambiguous", None), 3: ("novel", None), 4: ("novel", None)}


def test_phrase_search_both_ways_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "de,lta", "épsilon", "z"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(40)] + [None, "", "xalpha beta gamma z betax"]
    phrases = [" ".join(rng.choices(words, k=rng.randrange(1, 8))) for _ in range(25)] + ["", None, "alpha beta gamma z beta", "a", "lpha b", texts[0][3:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    given = spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(phrases)], "phrase_id string, phrase string")
    want = {(i, f"p{j}", t.index(p)) for i, t in enumerate(texts) if t for j, p in enumerate(phrases) if p and p in t}
    for chars in (1 << 20, 0):
        assert {tuple(r) for r in find_phrases(docs, given, chars).collect()} == want
    assert find_phrases(docs, given.limit(0)).count() == 0


def test_claimants_by_each_condition(spark):
    clusters = spark.createDataFrame([(1, ["Mood"], "about x", ["n1"]), (2, ["speed"], "The Big Theory holds", ["n2"]), (3, None, None, None)], "cluster_id int, dimensions array<string>, text string, node_ids array<string>")
    theories = spark.createDataFrame([("a", "big theory", ["mood"], ["n9"]), ("b", "", [], ["n1", "n2"]), ("c", None, None, None)], "theory_id string, name string, dimensions array<string>, node_ids array<string>")
    assert sorted(map(tuple, claimants(clusters, theories).collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("x + 2 * y", 7.0), ("X - z", 1.0), ("x / 0", 1.0), ("-x ** 2", 1.0), ("x < y", 0.0), ("y <= x", 2.0), ("x == y", 2.0), ("x >= y", 2.0), ("sqrt(0 - 4)", 0.0), ("max(x, y, 9)", 9.0), ("nothing", 0.0), ("hole + 1", 1.0),
        ("0 ** -1", 1.0), ("(0 - 8) ** 0.5", 1.0), ("10 ** 400", 1.0), ("1e200 ** 2", 1.0), ("x if y else 2", 1.0), ("open('f')", 1.0), ("x.y", 1.0), ("'a'", 1.0), ("1 < 2 < 3", 1.0), ("abs(x, y)", 1.0), ("((", 1.0), ("", 0.0), (None, 0.0), ("True + 1", 2.0), ("+".join(["1"] * 400), 1.0),
    ],
)
def test_formulas(spark, formula, want):
    row = spark.range(1).withColumn("p", F.create_map(F.lit("x"), F.lit(1.0), F.lit("Y"), F.lit(3.0), F.lit("hole"), F.lit(None).cast("double")))
    assert math.isclose(row.select(deviation(formula, F.col("p")).alias("d")).first().d, want)


def test_formula_tables(spark):
    rows = spark.createDataFrame([(1, {"a": 2.0}), (2, {}), (3, None)], "id int, parameters map<string,double>")
    laws = spark.createDataFrame([("f", "a * 2"), ("g", None)], "formula_id string, formula string")
    assert sorted(map(tuple, deviations(rows, laws).collect())) == [(1, "f", 4.0), (1, "g", 0.0), (2, "f", 0.0), (2, "g", 0.0), (3, "f", 0.0), (3, "g", 0.0)]
    assert deviations(rows, laws.limit(0)).count() == 0
    with pytest.raises(ValueError):
        deviations(rows, laws, most=1)


def test_leaf_fingerprints_of_any_shape(spark):
    import hashlib
    import json

    from argloom.operators.records import leaf_fingerprints

    def leaves(x, path=""):
        parts = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
        down = [(f"{path}.{k}" if path and isinstance(x, dict) else k if isinstance(x, dict) else f"{path}[{k}]", v) for k, v in parts]
        return [leaf for p, v in down for leaf in leaves(v, p)] if down else [(path, hashlib.sha256(json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest())]

    shapes = [{"a": [1, {"b": []}, [[2], "ü"]], "c": {"d": None, "e": {}}, "f": True}, {}, [3, ["x"]], "bare", {"k": {"k": {"k": "deep"}}}]
    rows = spark.createDataFrame([*((i, json.dumps(x)) for i, x in enumerate(shapes)), (9, None)], "id int, j string").select("id", F.parse_json("j").alias("v"))
    want = sorted((i, p, h) for i, x in enumerate(shapes) for p, h in leaves(x) if p)
    assert sorted(map(tuple, leaf_fingerprints(rows).collect())) == want
    assert leaf_fingerprints(rows.limit(0)).count() == 0


def test_graphml_and_events_come_back(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from argloom.sources import documents as S

    nodes = [('a"<&>', "x\ny"), ("b", None), ("&amp;", "")]
    edges = [("b", 'a"<&>', "sup<ports>"), ("b", "b", None)]
    n, e = spark.createDataFrame(nodes, "node_id string, name string").repartition(3), spark.createDataFrame(edges, "source string, target string, relation string")
    path = str(tmp_path / "graph")
    S.write_graphml(n, e, path)
    back = S.read_graphml(spark, path)
    assert sorted(map(tuple, back[0].collect())) == sorted((i, x or "") for i, x in nodes)
    assert sorted(map(tuple, back[1].collect())) == sorted((a, b, r or "") for a, b, r in edges)
    import xml.etree.ElementTree as ET

    parts = sorted((tmp_path / "graph").glob("part-*"))
    assert len(ET.fromstring("".join(p.read_text() for p in parts))[2]) == 5
    with pytest.raises(AnalysisException):
        S.write_graphml(n, e, path)
    with pytest.raises(Exception, match="broken"):
        S.write_graphml(n.select("node_id", F.raise_error(F.lit("broken")).cast("string").alias("name")), e, str(tmp_path / "none"))
    assert not list(tmp_path.glob("none/part-*"))
    S.append_events(e, str(tmp_path / "events"))
    S.append_events(e.limit(1), str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "events")).count() == 3


def test_pareto_front_equals_brute_force(spark):
    from argloom.operators.evaluation import pareto

    rng = random.Random(8)
    points = [(i, rng.randrange(12), rng.randrange(12)) for i in range(60)] + [(100, None, 1), (101, 3, None)]
    better = lambda a, b: a[1] >= b[1] and a[2] <= b[2] and a[1:] != b[1:]
    want = {p[0] for p in points[:60] if not any(better(q, p) for q in points[:60])}
    df = spark.createDataFrame(points, "id int, q int, c int")
    for parts in (1, 5):
        assert {r.id for r in pareto(df, "q", "c", parts).collect()} == want
    assert pareto(df.limit(0), "q", "c").count() == 0


def test_consolidation_keeps_links_and_no_pairs(spark, monkeypatch):
    """Of a group of n vectors that are all alike, at most a link per vector and task is stored; sets may have more members than a word has bits."""
    import random

    from argloom.operators import retrieval as R

    monkeypatch.setattr(J, "BLOCK", 7)
    r, n, stored = random.Random(6), 60, []
    v = [(i, i % 2, [1.0 + r.random() / 10, float(i % 3 == 0), 0.1]) for i in range(n)] + [(100, None, [1.0, 0.0, 0.1])]
    sets = {i: {f"s{k}" for k in range(100 if i % 5 else 0)} - ({"s0"} if i % 7 else set()) for i in range(n)}
    monkeypatch.setattr(R, "cut", lambda df, cut=R.cut: stored.append(cut(df)) or stored[-1])
    rows = [(i, s) for i, x in sets.items() for s in sorted(x)]
    got = {x.id: x.canonical for x in R.consolidate(spark.createDataFrame(v, "id int, label int, v array<double>"), spark.createDataFrame(rows, "id int, signature string"), 0.9, 0.8, 3).collect()}

    def alike(a, b):
        dot = sum(p * q for p, q in zip(a[2], b[2], strict=True)) / (sum(p * p for p in a[2]) * sum(p * p for p in b[2])) ** 0.5
        x, y = sets[a[0]], sets[b[0]]
        return a[1] == b[1] and dot >= 0.9 and (not x | y or len(x & y) / len(x | y) >= 0.8)

    want = {a[0]: a[0] for a in v}
    pairs = [(a[0], b[0]) for a in v[:n] for b in v[:n] if a[0] < b[0] and alike(a, b)]
    for _ in v:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(set(want.values())) < 15
    linked = [df for df in stored if "source" in df.columns or df.columns == ["a", "b"]]
    assert len(linked) == 1 and linked[0].count() <= 4 * n < len(pairs)
