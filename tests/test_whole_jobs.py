"""Queries whose registered SQL covers a part of the job, against the whole of it."""

import duckdb
import pytest

from argloom.plans.bindings import EDGES_SQL, TRADE_SQL
from argloom.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "customer supplier orders lineitem documents".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_transitive_disjointness_has_paths_of_four_hops(spark, con):
    t = con.sql(f"WITH {TRADE_SQL.format(k=3)} SELECT source, target FROM t").fetchall()
    supports = [e for e in t if sum(e) % 3]
    want, ends = set(), set(supports)
    for _ in range(3):
        ends = {(a, d) for a, b in ends for c, d in supports if b == c}
        want |= ends & {e for e in t if sum(e) % 3 == 0}
    assert want
    assert sorted(map(tuple, QUERIES["joi17_transitive_disjointness"](spark, SF).collect())) == sorted(want)


def test_shared_chunk_pairs_reads_all_line_items(spark, con):
    pairs = "WITH m AS (SELECT DISTINCT o_custkey AS a, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT x.a, y.a, count(*) FROM m x JOIN m y ON x.p = y.p AND x.a < y.a GROUP BY 1, 2"
    got = QUERIES["joi09_shared_chunk_pairs"](spark, SF).select("a", "b", "n_shared").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(pairs).fetchall())


def test_latex_cleanup_reads_whole_texts(spark, con):
    lengths = "SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace('x ' || lang || ' y ' || text, '\\\\[a-zA-Z]+\\*?\\{([^}]*)\\}', '\\1', 'g'), '\\\\[a-zA-Z]+\\*?', '', 'g'), '[ \\t]+', ' ', 'g'), ' ')) FROM documents"
    got = QUERIES["src03_latex_cleanup"](spark, SF).select("doc_id", "chars").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(lengths).fetchall())


def test_edge_tenability_judges_all_edges(spark, con):
    means = "p AS (SELECT source, relation, avg(weight) AS w FROM e GROUP BY 1, 2), q AS (SELECT target, relation, avg(weight) AS w FROM e GROUP BY 1, 2), k AS (SELECT DISTINCT source, target FROM e)"
    tension = f"WITH {EDGES_SQL}, {means} SELECT k.source, k.target, max(abs(p.w - q.w)) FROM k JOIN p ON p.source = k.source JOIN q ON q.target = k.target AND q.relation = p.relation GROUP BY 1, 2"
    want = {(s, t): w for s, t, w in con.sql(tension).fetchall()}
    got = {(r.source, r.target): float(r.tension) for r in QUERIES["agg22_edge_tenability"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=6e-5)
