import json

from pyspark.sql import functions as F

from argloom.sources import documents as D
from argloom.streaming import events as S


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n<!-- x\ny -->\n\n\n\nbody ")
    (tmp_path / "b.tex").write_text("\\emph{x} \\noindent y \\bibliography{r, s}")
    got = {r.kind: r.text for r in D.read_texts(spark, str(tmp_path)).collect()}
    assert got["markdown"] == "# T\n\n\nbody" or got["markdown"] == "# T\n\nbody"
    assert got["latex"].startswith("x y")
    raw = spark.createDataFrame([("p", "\\bibliography{r, s}")], "path string, text string")
    assert {r.bib for r in D.bibliographies(raw).collect()} == {"r", "s"}


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("r1", "atom", 1), ("r1", "chunk", 2), ("r2", "atom", 3)], "run_id string, kind string, n int")
    D.write_artifacts(rows, path)
    assert D.read_artifacts(spark, path, "r1", "atom").collect()[0].n == 1
    other = spark.createDataFrame([("r1", "atom", 9), ("r3", "atom", 4)], "run_id string, kind string, n int")
    assert {r.n for r in D.first_root_wins([rows, other]).collect()} == {1, 2, 3, 4}
    m = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run_id string, created_at int, status string")
    assert [x.status for x in D.latest_manifest(m).collect()] == ["b"]


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in D.read_json_tolerant(spark, str(tmp_path), "a long").collect()) == [1, 2]


def test_theory_net(spark, tmp_path):
    graph = [{"@id": "t1", "@type": "str:TheoryElement", "rdfs:label": "T1"}, {"@id": "t2", "@type": "str:TheoryElement", "str:specializes": "t1", "str:attacks": ["t3", "t4"]}]
    (tmp_path / "n.jsonld").write_text(json.dumps({"@graph": graph}))
    nodes, edges = D.theory_net(spark, str(tmp_path))
    assert {(r.node_id, r.node_type) for r in nodes.collect()} == {("t1", "TheoryElement"), ("t2", "TheoryElement")}
    assert {(r.source, r.target, r.relation) for r in edges.collect()} == {("t1", "t2", "specializes"), ("t2", "t3", "attacks"), ("t2", "t4", "attacks")}


def test_corpora(spark, tmp_path):
    doc = {"doc_key": "d", "sentences": [["a", "b"], ["c"]], "ner": [[[0, 1, "X"]], [[2, 2, "Y"]]], "relations": [[[0, 1, 2, 2, "USES"], [0, 0, 2, 2, "BAD"]]]}
    (tmp_path / "s.jsonl").write_text(json.dumps(doc))
    entities, relations = D.scierc(spark, str(tmp_path / "s.jsonl"))
    assert {r.text for r in entities.collect()} == {"a b", "c"}
    assert [tuple(r) for r in relations.select("source", "target", "relation").collect()] == [("a b", "c", "USES")]
    (tmp_path / "f.jsonl").write_text(json.dumps({"claim": "x", "evidence": {"7": [], "8": []}}))
    assert {r.doc_id for r in D.scifact(spark, str(tmp_path / "f.jsonl")).collect()} == {"7", "8"}
    (tmp_path / "m.json").write_text(json.dumps({"id": "d", "components": [{"id": "c1", "text": "t", "type": "claim", "chunk_id": "k"}], "relations": []}))
    components, links = D.argument_texts(spark, str(tmp_path / "m.json"))
    assert components.first().text == "t" and links.count() == 0


def test_cache(spark):
    asks = spark.createDataFrame([("p", 1), ("q", 1)], "prompt string, n int")
    keys = D.cached_responses(asks, spark.createDataFrame([], "key string, response string"))[1]
    cache = keys.filter("prompt = 'p'").select("key", F.lit("hit").alias("response"))
    hits, misses = D.cached_responses(asks, cache)
    assert hits.first().response == "hit" and misses.first().prompt == "q"


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = lambda: S.read_events(spark, str(tmp_path / "in"), 2)
    S.run_to_table(S.running_metrics(stream()), "m1", str(tmp_path / "c1"))
    assert set(spark.table("m1").collect()) == set(S.running_metrics(events).collect())
    S.run_to_files(S.ring_buffer(stream(), 10), str(tmp_path / "ring"), str(tmp_path / "c2"))
    ring = spark.read.parquet(str(tmp_path / "ring"))
    assert ring.count() == events.count()
    last = {r.user_id: r.s for r in ring.groupBy("user_id").agg(F.max("seq").alias("s")).collect()}
    assert last == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    got = S.replay(ring, 0, 3).groupBy("user_id").count().collect()
    assert all(r["count"] == min(3, last[r.user_id]) for r in got)
    S.run_upserts(stream(), str(tmp_path / "out"), str(tmp_path / "c3"), "event_id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_working_memory(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "a b c"), (1, 1, "user", "c d"), (1, 2, "assistant", "x")], "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    S.run_to_files(S.working_memory(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")), 3), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got.episode, got.n_words, got.dropped) == (2, 1, 0)
