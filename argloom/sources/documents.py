"""Readers and writers.  Inputs are read by Spark's own readers only, so any store that Spark reaches will do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argloom.functions.text import latex, markdown


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files ``path, kind, text`` cleaned by what their suffix says: Markdown, LaTeX or plain text."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    suffix = F.lower(F.element_at(F.split("path", "\\."), -1))
    kind = F.when(suffix.isin("md", "markdown"), "markdown").when(suffix.isin("tex", "latex"), "latex").otherwise("text")
    clean = F.when(F.col("kind") == "markdown", markdown(F.col("value"))).when(F.col("kind") == "latex", latex(F.col("value"))).otherwise(F.regexp_replace("value", "^\\s+|\\s+$", ""))
    return raw.withColumn("kind", kind).select("path", "kind", clean.alias("text"))


def bibliographies(texts: DataFrame) -> DataFrame:
    """``path, bib`` for every bibliography that a LaTeX text names."""
    named = F.regexp_extract_all("text", F.lit("\\\\(?:bibliography|addbibresource)\\{([^}]*)\\}"), F.lit(1))
    return texts.select("path", F.explode(named).alias("names")).select("path", F.explode(F.split("names", ",")).alias("bib")).select("path", F.trim("bib").alias("bib"))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Appends artifacts, partitioned by run and kind."""
    artifacts.write.mode("append").partitionBy("run_id", "kind").parquet(path)


def read_artifacts(spark: SparkSession, path: str, run_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Artifacts of a run or kind; both are partition filters, so other folders are not listed."""
    found = spark.read.parquet(path)
    for column, wanted in (("run_id", run_id), ("kind", kind)):
        if wanted is not None:
            found = found.filter(F.col(column) == wanted)
    return found


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The newest manifest of each run."""
    return manifests.groupBy("run_id").agg(F.max_by(F.struct(*manifests.columns), "created_at").alias("m")).select("m.*")


def first_root_wins(roots: list[DataFrame], key: str = "run_id") -> DataFrame:
    """The union of several roots; of runs that occur in more than one, the first root's rows stay."""
    ranked = [r.withColumn("_root", F.lit(i)) for i, r in enumerate(roots)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    first = every.groupBy(key).agg(F.min("_root").alias("_root"))
    return every.join(first, [key, "_root"], "left_semi").drop("_root")


def read_json_tolerant(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON records of a schema; unreadable ones are left out."""
    names = [f.split()[0] for f in schema.split(",")] if "<" not in schema else None
    found = spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=multi_line, mode="PERMISSIVE")
    good = found.filter("_corrupt_record IS NULL").drop("_corrupt_record")
    return good.select(*names) if names else good


ONTOLOGY_RELATIONS = ("specializes", "hasActualModel", "hasPotentialModel", "hasPartialPotentialModel", "hasConstraint", "hasParadigm", "presupposes", "attacks", "empiricallyEquivalent")


def theory_net(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON-LD files with an ``@graph``.  Values may be one id or a list.

    ``specializes`` is turned round (parent to child), ``empiricallyEquivalent`` goes both ways.
    """
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.@graph"), "array<map<string,string>>")).alias("m"))
    value = lambda *keys: F.coalesce(*(F.try_element_at("m", F.lit(k)) for k in keys))
    nodes = items.select(value("@id").alias("node_id"), F.element_at(F.split(value("@type"), ":"), -1).alias("node_type"), value("rdfs:label", "label").alias("name"))

    def targets(relation: str):
        raw = value(f"str:{relation}", relation)
        return F.when(F.startswith(F.trim(raw), F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))

    def pairs_of(relation: str):
        none = F.array().cast("array<struct<relation:string,target:string>>")
        return F.when(targets(relation).isNotNull(), F.transform(targets(relation), lambda t: F.struct(F.lit(relation).alias("relation"), t.alias("target")))).otherwise(none)

    pairs = F.concat(*map(pairs_of, ONTOLOGY_RELATIONS))
    edges = items.select(value("@id").alias("source"), F.explode(pairs).alias("e")).select("source", "e.target", "e.relation").filter("target IS NOT NULL")
    turned = edges.filter("relation IN ('specializes', 'empiricallyEquivalent')").select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")
    return nodes, edges.filter("relation <> 'specializes'").unionByName(turned)


def scierc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a JSONL corpus of token spans; relations with an unknown span are dropped."""
    schema = "doc_key string, sentences array<array<string>>, ner array<array<array<string>>>, relations array<array<array<string>>>"
    docs = spark.read.schema(schema).json(path).withColumn("tokens", F.flatten("sentences"))
    n = docs.select("doc_key", "tokens", F.explode(F.flatten("ner")).alias("x")).select("doc_key", "tokens", F.col("x")[0].cast("int").alias("start"), F.col("x")[1].cast("int").alias("end"), F.col("x")[2].alias("label"))
    entities = n.select("doc_key", "start", "end", "label", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start") + 1), " ").alias("text"))
    r = docs.select("doc_key", F.explode(F.flatten("relations")).alias("x"))
    r = r.select("doc_key", *(F.col("x")[i].cast("int").alias(c) for i, c in enumerate(("s1", "e1", "s2", "e2"))), F.col("x")[4].alias("relation"))
    side = lambda i: entities.select("doc_key", F.col("start").alias(f"s{i}"), F.col("end").alias(f"e{i}"), F.col("text").alias(f"text{i}")).distinct()
    return entities, r.join(side(1), ["doc_key", "s1", "e1"]).join(side(2), ["doc_key", "s2", "e2"]).select("doc_key", F.col("text1").alias("source"), F.col("text2").alias("target"), "relation")


def scifact(spark: SparkSession, path: str) -> DataFrame:
    """``claim, doc_id`` of the evidence that each claim names."""
    rows = spark.read.schema("claim string, evidence map<string,string>").json(path)
    return rows.select("claim", F.explode(F.map_keys("evidence")).alias("doc_id"))


def argument_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Components and relations of JSON files of argument graphs."""
    schema = "id string, components array<struct<id:string,text:string,type:string,chunk_id:string>>, relations array<struct<source_id:string,target_id:string,type:string>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs.select(F.col("id").alias("doc_id"), F.inline("components")), docs.select(F.col("id").alias("doc_id"), F.inline("relations"))


def cached_responses(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the response of a content-addressed cache, and those that miss it.  The key is a hash of all of a request's columns."""
    keyed = requests.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(requests.columns))), 256))
    return keyed.join(cache.select("key", "response"), "key"), keyed.join(cache.select("key"), "key", "left_anti")


def observations(rows: DataFrame) -> DataFrame:
    """Trace observations, one per id (the latest), with tokens, cost and latency filled from their alternatives, in order of time."""
    w = Window.partitionBy("id").orderBy(F.desc("start_time"))
    one = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    latency = F.coalesce("latency", F.greatest(F.lit(0.0), F.unix_micros("end_time") / 1e6 - F.unix_micros("start_time") / 1e6))
    return one.withColumn("latency", latency).withColumn("tokens", F.coalesce("tokens", F.col("input_tokens") + F.col("output_tokens"), F.lit(0))).withColumn("cost", F.coalesce("cost", F.lit(0.0))).orderBy("start_time", "id")


def write_report(metrics: DataFrame, path: str, thresholds: DataFrame) -> None:
    """Metric rows ``metric, value`` as CSV, with the flag whether each meets its threshold."""
    metrics.join(thresholds, "metric", "left").withColumn("meets", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(True))).write.mode("overwrite").csv(path, header=True)


def _escaped(value) -> Column:
    text = F.replace(F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit("&#10;"))


def _unescaped(value: Column) -> Column:
    for name, char in (("&#10;", "\n"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """``nodes(node_id, name)`` and ``edges(source, target, relation)`` as GraphML, one element a line, written by all tasks.

    The part files in the order of their names are one document.  Spark's committer publishes them together, so a failed
    attempt leaves nothing, and a path that is there already is an error.
    """
    spark = nodes.sparkSession
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'
    node = nodes.select(F.format_string('<node id="%s"><data key="name">%s</data></node>', _escaped(F.col("node_id")), _escaped(F.col("name"))).alias("value"))
    edge = edges.select(F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data></edge>', _escaped(F.col("source")), _escaped(F.col("target")), _escaped(F.col("relation"))).alias("value"))
    line(head).unionByName(node).unionByName(edge).unionByName(line("</graph></graphml>")).write.mode("errorifexists").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of :func:`write_graphml`; a missing name or relation comes back empty."""
    lines = spark.read.text(path)
    node, edge = '^<node id="([^"]*)"><data key="name">([^<]*)</data></node>$', '^<edge source="([^"]*)" target="([^"]*)"><data key="relation">([^<]*)</data></edge>$'
    part = lambda pattern, i: _unescaped(F.regexp_extract("value", pattern, i))
    return lines.filter(F.col("value").rlike(node)).select(part(node, 1).alias("node_id"), part(node, 2).alias("name")), lines.filter(F.col("value").rlike(edge)).select(part(edge, 1).alias("source"), part(edge, 2).alias("target"), part(edge, 3).alias("relation"))


def append_events(events: DataFrame, path: str) -> None:
    """Adds a batch of events to a sink of JSON lines; the batch is published as a whole or not at all, null fields are left out."""
    events.write.mode("append").json(path)
